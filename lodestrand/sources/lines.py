"""Line-oriented sources (S07–S10, S12, S15, S16, S19, S22, S26, S28) and the metric text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.scalar import label_unescape


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): every line of a text column, numbered from 1."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a file is one row until it is split."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return text_lines(files, "file", "value")


def is_json_object(line: str) -> Column:
    """True for lines that are one JSON object and nothing else."""
    text = F.trim(line, F.lit(" \t\r"))
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")), F.lit(False))


def timeline(lines: DataFrame, newest_first: bool = True, at: tuple[str, ...] = ("created_at", "timestamp", "ts")) -> DataFrame:
    """Rows of JSON object lines with their time; malformed, blank and scalar lines are skipped."""
    when = F.coalesce(*[F.get_json_object("line", f"$.{k}") for k in at], F.lit(""))
    return lines.where(is_json_object("line")).withColumn("at", when).orderBy(F.desc("at") if newest_first else F.asc("at"))


def tail(lines: DataFrame, key: str, count: int) -> DataFrame:
    """The last ``count`` lines of each text, in order."""
    back = Window.partitionBy(key).orderBy(F.desc("line_no"))
    return lines.withColumn("_p", F.row_number().over(back)).where(F.col("_p") <= count).drop("_p")


def session_lines(lines: DataFrame) -> DataFrame:
    """Line type: header (type session), event (other objects), raw (anything else)."""
    kind = F.get_json_object("line", "$.type")
    return lines.withColumn("kind", F.when(~is_json_object("line"), "raw").when(kind == "session", "header").otherwise("event"))


def metric_samples(lines: DataFrame) -> DataFrame:
    """(name, labels map, value) of Prometheus text lines; comments and unreadable values are skipped. Label
    values are unescaped; of a repeated label the last value counts."""
    shape = '^([A-Za-z_:][A-Za-z0-9_:]*)(?:\\{(.*)\\})?\\s+([^\\s]+)(?:\\s+\\d+)?$'
    part = lambda k: F.regexp_extract(F.trim("line"), shape, k)
    pair = '([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\\\]|\\\\.)*)"'
    names, texts = (F.regexp_extract_all(part(2), F.lit(pair), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(names, texts, lambda k, v: F.struct(k.alias("k"), label_unescape(v).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + F.lit(2), F.size(names)), lambda later: later == p["k"]))
    labels = F.map_from_entries(last)
    value = F.when(F.lower(part(3)) == "+inf", F.lit(float("inf"))).otherwise(part(3).try_cast("double"))
    return lines.where(~F.startswith(F.trim("line"), F.lit("#"))).select(part(1).alias("name"), labels.alias("labels"), value.alias("value")).where("name <> '' and value is not null")


def trajectory(lines: DataFrame, key: str) -> DataFrame:
    """Steps, distinct functions and greatest depth of each run's path log, one JSON object per line; lines that are no
    object count as steps without function and depth."""
    step = F.from_json("line", "function string, depth int")
    return lines.select(key, step.alias("s")).groupBy(key).agg(F.count("*").alias("steps"), F.countDistinct("s.function").alias("functions"), F.max("s.depth").alias("deepest"))


def includes(lines: DataFrame, key: str) -> DataFrame:
    """Distinct headers a text includes."""
    header = F.regexp_extract("line", '^\\s*#\\s*include\\s*[<"]([^>"]+)[>"]', 1)
    return lines.select(key, header.alias("header")).where("header <> ''").distinct()


def body_slice(lines: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """Lines first to last as one text with numbered lines."""
    rows = lines.where(F.col("line_no").between(first, last)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_x"))
    return rows.select(key, F.array_join(F.transform("_x", lambda x: F.format_string("%4d | %s", x["line_no"], x["line"])), "\n").alias("body"))


def best_file(files: DataFrame, group: str, name: str, size: str, modified: str, mentions: Column, least: int = 200) -> DataFrame:
    """Per group the newest large file that mentions the function, else the newest large, else the newest."""
    tier = F.when(mentions & (F.col(size) > least), 3).when(F.col(size) > least, 2).otherwise(1)
    return files.groupBy(group).agg(F.max_by(name, F.struct(tier, F.col(modified), F.col(name))).alias(name))


def unify(frames: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Frames with differing columns as one; columns that are missing get their default."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.fillna(defaults)


def write_metric_text(df: DataFrame, name: str, value: str, labels: list[str], path: str) -> None:
    """Rows as Prometheus text files."""
    from lodestrand.functions.scalar import label_escape, metric_value

    cells = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), label_escape(F.col(k).cast("string")), F.lit('"')) for k in labels])
    df.select(F.concat(F.lit(f"{name}{{"), cells, F.lit("} "), metric_value(value)).alias("value")).write.text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)
