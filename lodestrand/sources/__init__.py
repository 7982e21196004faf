"""Readers and writers for the formats run telemetry arrives in."""
