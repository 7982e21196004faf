"""Problem 5: files of one kind whose fields are added, renamed, removed or retyped over time.

Tagged-union inference. Each file is reduced, in parallel and on its own, to a profile: per level and
field path the set of type tags that occur (the alternatives are kept, not widened) and a digest of the
values after canonical conversion. Profiles fuse by set union. Neighbouring versions of a case are
compared by profile; the canonical table splits conflicting alternatives into typed branches next to the
converted value, objects and arrays as exact JSON text. Objects inside fields form levels of their own, to
any depth (``dag.followups[]``, ``edges.condition``): ``nested_changes`` reports them, ``changes`` the four
levels of the files.

Defined results: NULL, empty and unparseable bodies and bodies whose top is not an object are no version;
of several parseable bodies of one version the one loaded last (then the largest file id) counts; a NULL
case or version is no version; empty arrays and nulls have no type; an empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import durable, release

PREFIX = "analyze_"
CHANGE_SCHEMA = (
    "case_id long, case_version int, obj_level string, old_field string, new_field string, old_type string, new_type string"
)
_BUCKET = 512


def tag(value: object) -> str | None:
    """Type tag of a JSON value; None where it says nothing about the type."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, dict):
        return "object"
    inner = sorted({t for t in map(tag, value) if t})
    return "|".join(f"array<{t}>" for t in inner) or None


def canonical(value: object) -> object:
    """One form for a value under every type it is written with: text for scalars, a list for arrays.

    true/1/"true"/"1" agree, 12/"12" agree, a scalar agrees with the list that holds only it, an object of
    scalars agrees with its values joined by "=", and null, "" and empty lists and objects agree.
    """
    if value is None or value == "" or value == [] or value == {}:
        return None
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, str):
        return {"true": "1", "false": "0"}.get(value.strip().lower(), value)
    if isinstance(value, int | float):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    if isinstance(value, dict):
        parts = [canonical(v) for v in value.values()]
        return "=".join(p if isinstance(p, str) else json.dumps(p) for p in parts)
    items = [canonical(v) for v in value]
    return items[0] if len(items) == 1 else items


def function_of(key: str) -> str:
    """The function that an ``analyze_…`` key names."""
    return re.sub(r"_taint_.*$", "", key[len(PREFIX):])


def levels_of(top: dict) -> dict[str, list[tuple[str, dict]]]:
    """Objects of each level as (owner, object)."""
    nested = {k: v for k, v in top.items() if k.startswith(PREFIX)}
    dags = [(function_of(k), v) for k, v in nested.items() if isinstance(v, dict)] if nested else [("", top)]
    out = {"dag": dags, "nodes": [], "edges": []}
    if nested:
        out["file"] = [("", top)]
    for owner, dag in dags:
        for level in ("nodes", "edges"):
            items = dag.get(level)
            out[level] += [(owner, x) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    return out


def nested_levels(levels: dict[str, list[tuple[str, dict]]]) -> dict[str, list[tuple[str, dict]]]:
    """Objects inside the fields of ``levels``, to any depth: level.field for an object, level.field[] for those of a list."""
    out: dict[str, list[tuple[str, dict]]] = {}
    todo = deque((level, x) for level, objects in levels.items() for x in objects)
    while todo:
        level, (owner, obj) = todo.popleft()
        for name, value in obj.items():
            if name.startswith(PREFIX) or (level == "dag" and name in ("nodes", "edges")):
                continue
            inner = [(f"{level}.{name}", value)] if isinstance(value, dict) else [(f"{level}.{name}[]", x) for x in value if isinstance(x, dict)] if isinstance(value, list) else []
            for deeper, x in inner:
                out.setdefault(deeper, []).append((owner, x))
                todo.append((deeper, (owner, x)))
    return out


def parse(body: str | None) -> dict | None:
    """The top object of a body, None if it is not parseable or no object."""
    try:
        top = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return top if isinstance(top, dict) else None


def profile(top: dict, nested: bool = False) -> list[dict]:
    """Per level and field: its type tags, a digest of its values and whether those can identify it; of the four
    levels, or of the levels inside them.

    Values are taken with their position in the level, so that two fields agree only if they agree object
    by object. ``weak``: the values are all missing or all 0 or 1, which unrelated fields share by chance;
    ``varied``: both 0 and 1 occur.
    """
    out = []
    for level, objects in (nested_levels(levels_of(top)) if nested else levels_of(top)).items():
        fields: dict[str, tuple[set, list]] = {}
        for at, (_owner, obj) in enumerate(objects):
            for name, value in obj.items():
                tags, values = fields.setdefault(name, (set(), []))
                if t := tag(value):
                    tags.add(t)
                if level == "file" and name.startswith(PREFIX):
                    values.append(function_of(name))
                elif name in ("nodes", "edges") and level == "dag":
                    values.append((at, name))
                elif (c := canonical(value)) is not None:
                    values.append((at, c))
        for name, (tags, values) in fields.items():
            digest = hashlib.blake2b(json.dumps(values).encode(), digest_size=8).hexdigest()
            weak = all(isinstance(v, tuple) and v[1] in ("0", "1") for v in values)
            varied = weak and len({v[1] for v in values}) == 2
            out.append({"level": level, "field": name, "tags": "|".join(sorted(tags)), "digest": digest, "weak": weak, "varied": varied})
    return out


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)} - {"is", "has", "node"}


def compare(old: list[dict], new: list[dict]) -> list[tuple[str, str, str, str, str]]:
    """(level, old field, new field, old type, new type) of every difference of two profiles.

    A field that goes and one that comes with the same values are one renamed. Where the values are weak, the
    names must share a word or the types be equal, or there is no other field the two could belong to and
    both 0 and 1 occur.
    """
    out = []
    a = {(p["level"], p["field"]): p for p in old}
    b = {(p["level"], p["field"]): p for p in new}
    for key in a.keys() & b.keys():
        if a[key]["tags"] and b[key]["tags"] and a[key]["tags"] != b[key]["tags"]:
            out.append((*key, key[1], a[key]["tags"], b[key]["tags"]))
    gone = sorted(a.keys() - b.keys())
    come = sorted(b.keys() - a.keys())
    pairs = []
    for x in gone:
        for y in come:
            if x[0] == y[0] and a[x]["digest"] == b[y]["digest"]:
                shared = len(_words(x[1]) & _words(y[1]))
                alone = a[x]["varied"] and sum(a[z]["digest"] == a[x]["digest"] and z[0] == x[0] for z in gone) == 1 == sum(b[z]["digest"] == a[x]["digest"] and z[0] == x[0] for z in come)
                if not a[x]["weak"] or shared or a[x]["tags"] == b[y]["tags"] or alone:
                    pairs.append((-shared, a[x]["tags"] != b[y]["tags"], x, y))
    for _shared, _type, x, y in sorted(pairs):
        if x in gone and y in come:
            gone.remove(x)
            come.remove(y)
            out.append((x[0], x[1], y[1], a[x]["tags"], b[y]["tags"]))
    out += [(x[0], x[1], "", a[x]["tags"], "") for x in gone]
    out += [(y[0], "", y[1], "", b[y]["tags"]) for y in come]
    return sorted(out)


_PROFILE = pa.list_(
    pa.struct([("level", pa.string()), ("field", pa.string()), ("tags", pa.string()), ("digest", pa.string()), ("weak", pa.bool_()), ("varied", pa.bool_())])
)
_PROFILE_DDL = "array<struct<level:string,field:string,tags:string,digest:string,weak:boolean,varied:boolean>>"


def _profile_batches(nested: bool, body_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, profiles = [], []
            for k, body in enumerate(batch.column("body")):
                top = parse(body.as_py())
                if top is not None:
                    keep.append(k)
                    profiles.append(profile(top, nested))
            at = pa.array(keep, pa.int64())
            names = ["case_id", "case_version", "rank", *(["body"] if body_too else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), pa.array(profiles, _PROFILE)], [*names, "profile"])

    return run


def compare_nested(old: list[dict], new: list[dict]) -> list[tuple[str, str, str, str, str]]:
    """``compare`` of the inner levels that both have: one that comes or goes shows as a change of its field above."""
    both = {p["level"] for p in old} & {p["level"] for p in new}
    return compare([p for p in old if p["level"] in both], [p for p in new if p["level"] in both])


def _compare_batches(batches: Iterator[pa.RecordBatch], compare=compare) -> Iterator[pa.RecordBatch]:
    names = ["case_id", "case_version", "obj_level", "old_field", "new_field", "old_type", "new_type"]
    kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5]
    for batch in batches:
        rows = [
            (case, version, *change)
            for case, version, before, now in zip(*(batch.column(n).to_pylist() for n in ("case_id", "case_version", "before", "profile")), strict=True)
            for change in compare(before, now)
        ]
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def profiles(files: DataFrame, nested: bool = False, body_too: bool = False) -> DataFrame:
    """One profile per (case_id, case_version) with a parseable body; with that body if ``body_too``."""
    rank = F.struct(F.col("loaded_at").cast("long").alias("t"), F.col("file_id").cast("long").alias("f"))
    source = files.where("case_id is not null and case_version is not null and body is not null").select(
        F.col("case_id").cast("long"), F.col("case_version").cast("int"), F.col("body").cast("string"), rank.alias("rank")
    )
    kept = ["profile", *(["body"] if body_too else [])]
    read = source.mapInArrow(
        _profile_batches(nested, body_too),
        "case_id long, case_version int, rank struct<t:bigint,f:bigint>, " + ("body string, " if body_too else "") + f"profile {_PROFILE_DDL}",
    )
    best = read.groupBy("case_id", "case_version").agg(F.max_by(F.struct(*kept), "rank").alias("_b"))
    return best.select("case_id", "case_version", *[f"_b.{c}" for c in kept])


def with_previous(df: DataFrame, case: str, version: str, value: str, out: str, bucket: int = _BUCKET) -> DataFrame:
    """Adds ``out``: ``value`` of the version before. Versions are looked up within buckets of the version
    number, the first of a bucket in one row per earlier bucket: no task sorts all versions of a hot case."""
    df = df.withColumn("_b", F.floor(F.col(version) / F.lit(bucket)))
    inside = Window.partitionBy(case, "_b").orderBy(version)
    near = df.withColumn(out, F.lag(value).over(inside))
    last = near.groupBy(case, "_b").agg(F.max_by(value, version).alias("_v"))
    carried = last.select(case, "_b", F.lag("_v").over(Window.partitionBy(case).orderBy("_b")).alias("_v")).where("_v is not null")
    return near.join(carried, [case, "_b"], "left").withColumn(out, F.coalesce(out, "_v")).drop("_b", "_v")


def changes(files: DataFrame) -> DataFrame:
    """Every difference between a parseable version and the parseable version before it."""
    return _compared(durable(profiles(files)))


def nested_changes(files: DataFrame) -> DataFrame:
    """As ``changes`` for the objects inside the fields of the four levels; obj_level is their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare_batches(batches, compare_nested)

    return _compared(durable(profiles(files, nested=True)), run)


def _compared(shapes: DataFrame, run=_compare_batches) -> DataFrame:
    pairs = with_previous(shapes.select("case_id", "case_version", "profile"), "case_id", "case_version", "profile", "before").where("before is not null")
    return pairs.select("case_id", "case_version", "before", "profile").mapInArrow(run, CHANGE_SCHEMA)


# ---------------------------------------------------------------- one consistent table

FACT_SCHEMA = (
    "case_id long, case_version int, obj_level string, owner string, obj_no int, field string, type_tag string, value string, "
    "text_value string, number_value double, flag_value boolean, list_value array<string>, json_value string"
)


def field_names(profiled: DataFrame, changed: DataFrame) -> DataFrame:
    """(obj_level, field, name): the one name of each field's class. Names that any rename links are one class; the
    name that most versions use stands for it. Classes are found by joins, so that keys may be data."""
    used = durable(
        profiled.select(F.explode("profile").alias("p")).where(~F.startswith("p.field", F.lit(PREFIX)))
        .groupBy(F.col("p.level").alias("obj_level"), F.col("p.field").alias("field")).agg(F.count("*").alias("n"))
    )
    renamed = changed.where("old_field <> '' and new_field <> '' and old_field <> new_field").where(~F.startswith("old_field", F.lit(PREFIX)))
    one_way = renamed.select("obj_level", F.col("old_field").alias("field"), F.col("new_field").alias("other")).distinct()
    links = durable(one_way.unionByName(one_way.select("obj_level", F.col("other").alias("field"), F.col("field").alias("other"))).distinct())
    best = F.struct((-F.col("n")).alias("n"), F.col("field").alias("name"))
    label = durable(used.select("obj_level", "field", best.alias("best")))
    while True:  # the best name spreads along the links; as many rounds as the longest chain of renames
        sent = links.join(label.withColumnRenamed("field", "other"), ["obj_level", "other"]).select("obj_level", "field", "best")
        wider = durable(label.unionByName(sent).groupBy("obj_level", "field").agg(F.min("best").alias("best")))
        same = wider.join(label, ["obj_level", "field", "best"], "left_anti").isEmpty()
        release(label)
        label = wider
        if same:
            return label.select("obj_level", "field", F.col("best.name").alias("name"))


def _branches(value: object) -> tuple:
    """(canonical text, text, number, flag, list, JSON): the canonical conversion and the branch of the value's own type;
    objects and lists also as JSON text, with their keys and order."""
    form = canonical(value)
    text = form if form is None or isinstance(form, str) else json.dumps(form, ensure_ascii=False)
    flag = value if isinstance(value, bool) else None
    number = float(value) if isinstance(value, int | float) and flag is None else None
    items = None
    if isinstance(value, list):
        items = [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in map(canonical, value) if x is not None]
    whole = json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else None
    return text, value if isinstance(value, str) else None, number, flag, items, whole


def _loose(top: dict) -> Iterator[tuple[str, str, int, object]]:
    """(level, owner, place in its list, value) of the elements of nodes and edges that are no objects."""
    for owner, dag in levels_of(top)["dag"]:
        for level in ("nodes", "edges"):
            items = dag.get(level)
            yield from ((level, owner, k, x) for k, x in enumerate(items if isinstance(items, list) else ()) if not isinstance(x, dict))


_FACTS = pa.schema([
    ("case_id", pa.int64()), ("case_version", pa.int32()), ("obj_level", pa.string()), ("owner", pa.string()), ("obj_no", pa.int32()), ("field", pa.string()),
    ("type_tag", pa.string()), ("value", pa.string()), ("text_value", pa.string()), ("number_value", pa.float64()), ("flag_value", pa.bool_()),
    ("list_value", pa.list_(pa.string())), ("json_value", pa.string()),
])


def _facts_of(case: int, version: int, top: dict) -> Iterator[tuple]:
    for level, owner, at, x in _loose(top):
        yield case, version, level, owner, at, "", tag(x), *_branches(x)
    for level, objects in levels_of(top).items():
        for at, (owner, obj) in enumerate(objects):
            for name, value in obj.items():
                if not name.startswith(PREFIX) and not (level == "dag" and name in ("nodes", "edges") and (value is None or isinstance(value, list))):
                    yield case, version, level, owner, at, name, tag(value), *_branches(value)


def _fact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(_FACTS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FACTS, strict=True)], schema=_FACTS)

    for batch in batches:
        for case, version, body in zip(*(batch.column(n) for n in ("case_id", "case_version", "body")), strict=True):
            for row in _facts_of(case.as_py(), version.as_py(), parse(body.as_py())):
                rows.append(row)
                if len(rows) >= 50_000:
                    yield made()
                    rows.clear()
    yield made()


def facts(files: DataFrame) -> DataFrame:
    """Every field of every object of every parseable version under one name: FACT_SCHEMA.

    ``type_tag`` tells which typed branch holds the value as written; ``value`` is its canonical text, equal for
    all types it was ever written with, and ``json_value`` the exact text of objects and lists. Nulls and empty
    values keep their row with a NULL value. The nested lists of nodes and edges are levels of their own and no
    fields; an element of theirs that is no object has the field '' and its place in the list as obj_no.
    """
    shapes = durable(profiles(files, body_too=True))
    names = field_names(shapes, _compared(shapes)).withColumnRenamed("name", "_name")
    rows = shapes.select("case_id", "case_version", "body").mapInArrow(_fact_batches, FACT_SCHEMA)
    named = rows.join(names, ["obj_level", "field"], "left").withColumn("field", F.coalesce("_name", "field"))
    return named.select(*_FACTS.names)
