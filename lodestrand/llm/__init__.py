"""Operators for text corpora: representatives, tokenizer encoding, source mixing, personal information."""
