"""Queries of the llm subpackage (p3, p7, p8, p9) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.keys import func_key, taint_key, task_key
from lodestrand.llm import encoding, mixing, pii, representatives
from lodestrand.session import durable, table

FIELDS = ["line", "taint", "checks_json", "prune_json"]


def _node_group() -> Column:
    return F.concat(
        func_key("func_id"), F.lit("|"), taint_key("taint_signature"), F.lit("|"), task_key("task_id"), F.lit("|"), F.col("node_id").cast("string")
    )


def _node_fields(spark: SparkSession, sf_dir: str, least: int, weighting: str = "precedence") -> DataFrame:
    writers = table(spark, sf_dir, "writers").select(F.col("writer").alias("written_by"), F.col("trust").cast("long").alias("trust"))
    rows = table(spark, sf_dir, "dag_nodes").select(
        "rec_id", "func_id", "taint_signature", "task_id", "node_id", "written_by", "written_at", *FIELDS
    )
    # writers is a fixed table; its size is Spark's to check
    rows = rows.join(writers.groupBy("written_by").agg(F.max("trust").alias("trust")), "written_by", "left")
    return representatives.representatives(
        rows, _node_group(), "rec_id", FIELDS, F.col("trust"), F.unix_micros("written_at"), least_records=least, weighting=weighting,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value is closest to the consensus, a value outweighing all lower ranked ones, per group of two or more and field."""
    return _node_fields(spark, sf_dir, 2).select("first_rec_id", "field_name", "rec_id")


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per node: each field filled from the best record that has it, NULL if none has."""
    nodes = table(spark, sf_dir, "dag_nodes").groupBy(_node_group().alias("g")).agg(F.min(F.col("rec_id").cast("long")).alias("first_rec_id"))
    filled = (
        _node_fields(spark, sf_dir, 1).groupBy("first_rec_id")
        .agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS])
    )
    return nodes.where("g is not null").select("first_rec_id").join(filled, "first_rec_id", "left")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value closest to the token-wise majority, per group of two or more and field: votes weigh as much as their writer's trust."""
    return _node_fields(spark, sf_dir, 2, "votes").select("first_rec_id", "field_name", "rec_id", "value")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encoding.encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids differ from their text (none): (doc_id, text)."""
    documents = table(spark, sf_dir, "documents")
    back = encoding.decode(encoding.encode(documents)).withColumnRenamed("text", "_back")
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.join(back, "doc_id").where("text <> _back").select("doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(encoding.token_counts(table(spark, sf_dir, "documents")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of documents in each mix of mix_targets, in order of virtual finish time."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, sf_dir), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal information, once per document."""
    return pii.found(table(spark, sf_dir, "documents"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with typed placeholders in place of personal information."""
    return pii.redacted(table(spark, sf_dir, "documents"))


_CELLS = r"""
WITH r AS (
    SELECT rec_id, written_at, coalesce(w.trust, 0) AS trust, line, taint, checks_json, prune_json,
        regexp_replace(lower(trim(func_id)), '^0x', '') || '|' ||
        regexp_replace(regexp_replace(regexp_replace(taint_signature, '\s+', '', 'g'), '^(this|self)(->|\.)', ''), '[()]+$', '') || '|' ||
        replace(lower(trim(task_id)), '_', '-') || '|' || node_id AS g
    FROM dag_nodes LEFT JOIN writers w ON w.writer = written_by),
k AS (SELECT g, min(rec_id) AS first_rec_id, count(*) AS n FROM r WHERE g IS NOT NULL GROUP BY g),
c AS (
    SELECT g, rec_id, written_at, trust, 'line' AS field_name, CAST(line AS VARCHAR) AS v FROM r UNION ALL
    SELECT g, rec_id, written_at, trust, 'taint', taint FROM r UNION ALL
    SELECT g, rec_id, written_at, trust, 'checks_json', checks_json FROM r UNION ALL
    SELECT g, rec_id, written_at, trust, 'prune_json', prune_json FROM r),
b AS (
    SELECT g, rec_id, field_name, v, row_number() OVER (PARTITION BY g, field_name ORDER BY trust DESC, written_at DESC NULLS LAST, rec_id DESC) AS p
    FROM c WHERE v IS NOT NULL AND lower(regexp_replace(v, '\s+', '', 'g')) NOT IN ('', '0', '[]', '{}', 'null'))
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p3_consensus": p3_consensus,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
SQL = {
    "p3_found": _CELLS + "SELECT k.first_rec_id, b.field_name, b.rec_id FROM b JOIN k USING (g) WHERE b.p = 1 AND k.n > 1",
    "p3_survivors": _CELLS
    + "SELECT k.first_rec_id, "
    + ", ".join(f"max(CASE WHEN b.field_name = '{f}' THEN b.v END) AS {f}" for f in FIELDS)
    + " FROM k LEFT JOIN b ON b.g = k.g AND b.p = 1 GROUP BY 1",
    "p7_round_trip": "SELECT doc_id, text FROM documents WHERE false",
}
