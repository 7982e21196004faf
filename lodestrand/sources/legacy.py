"""Legacy single-file databases (S11, S12, S14), process tables (S24) and paged sources with early stop."""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrand.session import shared_dir


def _open_read_only(path: str) -> sqlite3.Connection:
    """Read-only; a file on a medium that allows no locks is opened as immutable."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        con.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchall()
    except sqlite3.OperationalError:
        con.close()
        con = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    return con


def read_sqlite(spark: SparkSession, paths: list[str], name: str, schema: str, batch: int = 10_000) -> DataFrame:
    """Table ``name`` of many database files, one task per file, with ``path`` as first column.

    Columns a file lacks are NULL, columns not asked for are left out; files without the table give no rows.
    The files must be readable under the same path on every executor.
    """
    wanted = StructType.fromDDL(schema)
    names = wanted.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path in part["path"]:
                con = _open_read_only(path)
                try:
                    there = {r[1] for r in con.execute(f'PRAGMA table_info("{name}")')}
                    if there:
                        picked = ", ".join(f'"{n}"' if n in there else f'NULL AS "{n}"' for n in names)
                        rows = con.execute(f'SELECT {picked} FROM "{name}"')
                        while chunk := rows.fetchmany(batch):
                            yield pd.DataFrame(chunk, columns=names).assign(path=path)[["path", *names]]
                finally:
                    con.close()

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
    return files.mapInPandas(run, StructType.fromDDL("path string, " + schema))


def pages_until(fetch: Callable[[int], list[dict]], watermark: str | None, at: str = "updated_at") -> Iterator[dict]:
    """Rows of numbered pages, newest first, until a whole page is older than the watermark or empty.

    Rows without a time count as new. The caller turns the rows into a table, or writes them as JSON lines.
    """
    number = 1
    while rows := fetch(number):
        fresh = [r for r in rows if watermark is None or not r.get(at) or str(r[at]) >= watermark]
        yield from fresh
        if not fresh:
            return
        number += 1


def read_pages(spark: SparkSession, fetch: Callable[[int], list[dict]], watermark: str | None, schema: str, at: str = "updated_at", batch: int = 10_000) -> DataFrame:
    """The rows of ``pages_until`` as a table. One task turns the pages, which follow each other by definition, and gives
    them out in batches; the driver sees none of them."""
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _ in range(len(part)):
                rows: list[dict] = []
                for row in pages_until(fetch, watermark, at):
                    rows.append({n: row.get(n) for n in names})
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.range(1).coalesce(1).mapInPandas(run, schema)


def demo(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """A small table written into a legacy database file in the shared folder, and read from it."""
    folder = shared_dir(rows.sparkSession).removeprefix("file://")
    os.makedirs(f"{folder}/lodestrand", exist_ok=True)
    path = f"{folder}/lodestrand/{uuid.uuid4().hex}.sqlite"
    with sqlite3.connect(path) as con:
        con.execute(f'CREATE TABLE "{name}" ({", ".join(rows.columns)})')
        con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(rows.columns))})', [tuple(r) for r in rows.limit(1000).collect()])
    con.close()
    return read_sqlite(rows.sparkSession, [path], name, schema)


def page_file(folder: str) -> Callable[[int], list[dict]]:
    """Pages stored as page-1.json, page-2.json … in a folder."""
    def fetch(number: int) -> list[dict]:
        try:
            with open(f"{folder}/page-{number}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    return fetch


def read_processes(spark: SparkSession, folder: str, matching: str = "") -> DataFrame:
    """(pid, args, command) of a process table: a folder with one folder per process that holds its ``cmdline``, words ended
    by NUL. The table of one machine, or dumps of many under one path. Folders without a number and processes with an empty
    command line (kernel threads) do not count; ``matching`` is a regular expression the command must contain."""
    text = spark.read.text(f"{folder}/*/cmdline", wholetext=True, lineSep="\x01").select(F.regexp_extract(F.col("_metadata.file_path"), "/(\\d+)/cmdline$", 1).alias("pid"), "value")
    args = F.filter(F.split("value", "\x00"), lambda a: a != "")
    rows = text.where("pid <> ''").select(F.col("pid").cast("long").alias("pid"), args.alias("args")).where(F.size("args") > 0)
    return rows.withColumn("command", F.array_join("args", " ")).where(F.col("command").rlike(matching))


def demo_processes(rows: DataFrame, pid: str, words: list[str]) -> DataFrame:
    """A small process table written into the shared folder, and read from it."""
    folder = f"{shared_dir(rows.sparkSession).removeprefix('file://')}/lodestrand/proc-{uuid.uuid4().hex}"
    os.makedirs(f"{folder}/self")
    for row in rows.limit(1000).collect():
        os.makedirs(f"{folder}/{row[pid]}", exist_ok=True)
        with open(f"{folder}/{row[pid]}/cmdline", "wb") as f:
            f.write(b"".join(str(row[w]).encode() + b"\x00" for w in words if row[w] is not None))
    with open(f"{folder}/self/cmdline", "wb") as f:
        f.write(b"me\x00")
    return read_processes(rows.sparkSession, f"file://{folder}")
