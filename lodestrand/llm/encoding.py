"""Problem 7: the whole corpus as token ids of a public tokenizer, with offsets, and back.

The vocabulary file is loaded once per Python worker from a path that is a parameter; texts pass through
the tokenizers library in Arrow batches. Offsets refer to characters of the text. Decoding reverses the
byte-to-character table of byte-level vocabularies and joins the bytes before reading them as UTF-8, so
characters split over several tokens come back whole.

Defined results: an empty text has the ids [], a NULL text has the ids [] as well; special token strings
inside a text are ordinary text; texts are never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT = "byte_bpe_50k"


def tokenizer_path(name: str = DEFAULT) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file, once per process; strings of special tokens count as text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.no_padding()
    found.no_truncation()
    return found


@functools.lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """Reverse of the byte-level alphabet: printable bytes stand for themselves, the others, in order,
    for the characters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = {}, 256
    for byte in range(256):
        if byte in printable:
            table[chr(byte)] = byte
        else:
            table[chr(spare)] = byte
            spare += 1
    return table


def decode_ids(ids: list[int] | None, path: str) -> str | None:
    """The text of ``ids`` of a byte-level vocabulary; bytes that are no UTF-8 become U+FFFD."""
    if ids is None:
        return None
    tok, table = load(path), byte_of_char()
    out = bytearray()
    for token in map(tok.id_to_token, ids):
        if token is None:
            continue
        plain = [table.get(c) for c in token]
        out += token.encode() if None in plain else bytes(plain)
    return out.decode("utf-8", errors="replace")


def _encode_batches(path: str, offsets: bool, size: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        kinds = pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = [t or "" for t in part.column(1).to_pylist()]
                encoded = tok.encode_batch(texts, add_special_tokens=False)
                cols, names = [part.column(0), pa.array([e.ids for e in encoded], kinds)], ["doc_id", "ids"]
                if offsets:
                    cols += [pa.array([[x[k] for x in e.offsets] for e in encoded], kinds) for k in (0, 1)]
                    names += ["begins", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(documents: DataFrame, path: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids[, begins, ends]) of every document: token ids and their character offsets. No shuffle."""
    schema = "doc_id long, ids array<int>" + (", begins array<int>, ends array<int>" if offsets else "")
    return documents.select("doc_id", "text").mapInArrow(_encode_batches(path or tokenizer_path(), offsets), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_counts(documents: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns of every document and ``tokens``, its number of ids."""
    path = path or tokenizer_path()
    kept = documents.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for batch in batches:
            n = batch.num_columns - 1
            counts = []
            for at in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column(n).slice(at, 512).to_pylist()]
                counts += [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64())], [*keep, "tokens"])

    return kept.mapInArrow(run, f"{fields}, tokens bigint")
