"""Session, table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrand", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. Cluster settings given by spark-submit stay as they are."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows that hold whole lists or graphs: a batch ends at 64 MiB, whatever their number
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, list[str]] = {}  # application -> folders of its durable tables, oldest first


def _is_local(spark: SparkSession) -> bool:
    """True where driver and executors are one process of this machine."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session takes a folder of this
    machine, removed when the process ends; any other session is refused, as each executor would write to
    its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lodestrand.shared.dir", None)
    if found:
        return found
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"lodestrand-{os.getpid()}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.lodestrand.shared.dir", "file://" + folder)
    return "file://" + folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as parquet into the shared folder and read again.

    Cuts the lineage: the files survive the loss of any executor. ``release`` removes them when a
    loop no longer needs them, ``sweep`` or the end of a ``scratch`` block the rest.
    """
    spark = df.sparkSession
    app = spark.conf.get("spark.app.id", "app")
    path = f"{shared_dir(spark)}/lodestrand/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(app, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrand_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(*frames: DataFrame | None) -> None:
    """Remove the files behind ``durable`` frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestrand_path", None)
        if path:
            _delete(df.sparkSession, path)
            known = _made.get(df.sparkSession.conf.get("spark.app.id", "app"), [])
            if path in known:
                known.remove(path)


def sweep(spark: SparkSession, keep: int = 0) -> int:
    """Remove the durable tables of this application but for the oldest ``keep``; how many were removed.

    Query results read them lazily: sweep after the result has been written or collected.
    """
    known = _made.get(spark.conf.get("spark.app.id", "app"), [])
    gone = known[keep:]
    del known[keep:]
    for path in gone:
        _delete(spark, path)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Durable tables made inside the block are removed at its end: use the results inside."""
    before = len(_made.get(spark.conf.get("spark.app.id", "app"), []))
    try:
        yield
    finally:
        sweep(spark, before)
