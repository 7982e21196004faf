"""Problem 7."""

import pytest

from lodestrand.llm import encoding as E

TEXTS = ["", None, " ", "plain text", "naïve café 👩‍💻 🇪🇺", "污点通过全局变量", "a\r\nb\tc\x00d‮abc", "<|endoftext|>", "x" * 200_000, "ﬁeld ０１２３ مخزن"]


@pytest.fixture(scope="module")
def docs(spark):
    pytest.importorskip("public_tokenizers")
    return spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids int")


def test_ids_round_trip_and_defined_cases(spark, docs):
    encoded = E.encode(docs)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids[0] == [] and ids[1] == [] and 50256 not in ids[7]
    back = {r["doc_id"]: r["text"] for r in E.decode(encoded).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(TEXTS))


def test_agrees_with_another_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in E.encode(docs).collect():
        assert r["ids"] == other.encode_ordinary(TEXTS[r["doc_id"]] or "")


def test_offsets_cover_the_text(docs):
    for r in E.encode(docs, offsets=True).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert len(r["ids"]) == len(r["begins"]) == len(r["ends"])
        covered = set()
        for a, b in zip(r["begins"], r["ends"], strict=True):
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))


def test_counts_and_empty_table(docs):
    got = {r["doc_id"]: r["tokens"] for r in E.token_counts(docs, keep=("doc_id",)).collect()}
    assert got[0] == got[1] == 0 and got[3] == 2
    assert E.encode(docs.limit(0)).count() == 0
    assert E.decode_ids(None, E.tokenizer_path()) is None
