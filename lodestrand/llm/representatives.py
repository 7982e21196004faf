"""Problem 3: the best representative of each group of duplicate records, field by field.

Token-level consensus. The distinct values of a field in a group are aligned progressively, heaviest
first, the weighted tokens of each column (a gap is a token) are voted on, and the existing value closest
to the consensus is emitted. The weights decide what "best" means:

* ``precedence``: the values are ranked by (trust, time, id) of their best record and a value outweighs all
  lower ones together (weight 2^rank), so the consensus follows the highest ranked record. Sums of different
  powers of 2 compare as their largest ones do: a token weighs as much as the highest rank that votes for it, a
  column is led by its heaviest token, and two columns disagree if their leading tokens do;
* ``votes``: a value weighs as much as its records' weights together, so the consensus follows the majority,
  token by token.

Every field with several values is aligned, voted on and compared with the consensus. Under ``votes`` a value with more
than half of the weight holds the majority of every column, so that it is the consensus without alignment. Alignment and
distance are exact whatever the length of the values: alignment goes row by row and traces back through kept rows;
distance, and alignment under ``precedence``, are bit-parallel.

Values are pre-aggregated per (group, field, value) before any shuffle of lists. Groups with more than
``FAN_IN`` distinct values are never packed into one row: buckets of values become profiles (token votes per column,
under ``precedence`` the leading token and its weight, as no other can come to lead), profiles are aligned to each other
in a tree, so that no vote is lost, and each value is then compared with the consensus where it lies. In such groups the
guide tree follows the hash of the values instead of their weight.

Defined results: records with a NULL or blank key part belong to no group; a field without any value gives
no row; of values equally close the heaviest wins, then the smallest text; equal ranks cannot occur as ids
are unique; repeated rows vote repeatedly; an empty input gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import zip_longest
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import durable, release

FAN_IN = 32
_TOKEN = re.compile(r"\w+|[^\w\s]")  # blanks do not vote


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


Profile = list[dict]  # per column the weight of each token, None for a gap
Ranked = list[tuple[str | None, int]]  # per column the leading token, None for a gap, and its weight


def _ends(a: list, b: list) -> tuple[int, int]:
    """How many items two lists share at the start, and at the end of what is left."""
    same = min(len(a), len(b))
    lo = next((k for k in range(same) if a[k] != b[k]), same)
    return lo, next((k for k in range(same - lo) if a[-1 - k] != b[-1 - k]), same - lo)


def _align(n: int, m: int, cost: Callable[[int], np.ndarray], gaps: np.ndarray, inserts: np.ndarray) -> list[tuple[int | None, int | None]]:
    """Cheapest alignment of ``n`` columns to ``m``: pairs in order, None for a gap.

    ``cost(i)``: of column i against each of the m; ``gaps[i]``: of leaving column i alone; ``inserts[j]``: of
    leaving j alone. Every k-th row of the table is kept, k about the root of n, and the rows between are made again on
    the way back: memory grows with the root of the table. Of equal ways a pair comes first, then a gap.
    """
    along = np.concatenate(([0], np.cumsum(inserts)))

    def row_after(above: np.ndarray, i: int) -> np.ndarray:
        best = np.minimum(above[:-1] + cost(i), above[1:] + gaps[i])
        return np.minimum.accumulate(np.concatenate(([above[0] + gaps[i]], best)) - along) + along

    every, row, kept = max(1, isqrt(n)), along, {0: along}
    for i in range(n):
        row = row_after(row, i)
        if (i + 1) % every == 0:
            kept[i + 1] = row
    pairs: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i:
        low = (i - 1) // every * every
        rows = [kept[low]]
        for k in range(low, i):
            rows.append(row_after(rows[-1], k))
        while i > low:
            here, above = rows[i - low], rows[i - low - 1]
            if j and here[j] == above[j - 1] + cost(i - 1)[j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here[j] == above[j] + gaps[i - 1]:
                i -= 1
                pairs.append((i, None))
            else:
                j -= 1
                pairs.append((None, j))
    pairs += [(None, k) for k in range(j - 1, -1, -1)]
    return pairs[::-1]


def merge(one: Profile, total_one: int, two: Profile, total_two: int) -> Profile:
    """Two profiles aligned to each other, their votes added. The cost of two columns is the share of pairs of
    votes that disagree."""
    if not one or not two:
        rest, gap = (two, total_one) if not one else (one, total_two)
        return [{**c, None: c.get(None, 0) + gap} if gap else dict(c) for c in rest]
    top = [max(c, key=c.get) for c in one], [max(c, key=c.get) for c in two]
    lo, hi = _ends(*top)
    a, b = one[lo: len(one) - hi], two[lo: len(two) - hi]
    pairs: list[tuple[int | None, int | None]] = [(None, j) for j in range(len(b))] if not a else [(i, None) for i in range(len(a))]
    if a and b:
        whole = total_one * total_two
        kind = np.int64 if whole * (len(a) + len(b) + 2) < 2**62 else np.float64  # votes beyond that are weighed as doubles
        at: dict[str | None, tuple[list[int], list[int]]] = {}
        for j, c in enumerate(b):
            for t, w in c.items():
                places, weights = at.setdefault(t, ([], []))
                places.append(j)
                weights.append(w)
        votes = {t: (np.array(p), np.array(w, dtype=kind)) for t, (p, w) in at.items()}

        def cost(i: int) -> np.ndarray:
            out = np.full(len(b), whole, dtype=kind)
            for t, w in a[i].items():
                if t in votes:
                    out[votes[t][0]] -= w * votes[t][1]
            return out

        gaps = np.array([(total_one - c.get(None, 0)) * total_two for c in a], dtype=kind)
        inserts = np.array([(total_two - c.get(None, 0)) * total_one for c in b], dtype=kind)
        pairs = _align(len(a), len(b), cost, gaps, inserts)
    tail = [(len(one) - hi + k, len(two) - hi + k) for k in range(hi)]
    out = []
    for i, j in [*((k, k) for k in range(lo)), *((None if i is None else lo + i, None if j is None else lo + j) for i, j in pairs), *tail]:
        column = dict(one[i]) if i is not None else {None: total_one}
        for t, w in (two[j] if j is not None else {None: total_two}).items():
            column[t] = column.get(t, 0) + w
        out.append(column)
    return out


def profile_of(weighted: list[tuple[str, int]]) -> tuple[Profile, int]:
    """(profile, total weight) of values with weights, aligned progressively, heaviest first."""
    profile, total = [], 0
    for value, weight in sorted(weighted, key=lambda x: (-x[1], x[0])):
        single = [{t: weight} for t in tokens(value)]
        profile = merge(profile, total, single, weight) if total else single
        total += weight
    return profile, total


def voted(profile: Profile) -> list[str]:
    """The heaviest token of each column; gaps give none, of equal weights a token goes before a gap."""
    best = [max(c, key=lambda t: (c[t], t is not None, t or "")) for c in profile]
    return [t for t in best if t is not None]


def consensus(weighted: list[tuple[str, int]]) -> list[str]:
    """Tokens voted column by column from values with weights."""
    return voted(profile_of(weighted)[0])


def _places(a: list[str]) -> dict[str, int]:
    """Per token the bits of its places."""
    where: dict[str, list[int]] = {}
    for k, t in enumerate(a):
        where.setdefault(t, []).append(k)
    out = {}
    for t, ks in where.items():
        bits = bytearray(len(a) // 8 + 1)
        for k in ks:
            bits[k >> 3] |= 1 << (k & 7)
        out[t] = int.from_bytes(bits, "little")
    return out


def _next_row(same: int, plus: int, minus: int, full: int) -> tuple[int, int, int, int]:
    """The row of distances after one more token, as bits: where it grows and falls along the row (plus, minus), and
    where it is above and below the row before (up, down). ``same``: places of the token."""
    vertical = same | minus
    level = (((same & plus) + plus) ^ plus) | same
    up, down = minus | (full & ~(level | plus)), plus & level
    over, under = (up << 1 | 1) & full, down << 1 & full
    return under | (full & ~(vertical | over)), over & vertical, up, down


def distance(a: list[str], b: list[str]) -> int:
    """Fewest insertions, deletions and replacements of tokens; one step of wide integers per token of ``b``."""
    if a == b:
        return 0
    lo, hi = _ends(a, b)
    a, b = a[lo: len(a) - hi], b[lo: len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    where, full, last = _places(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for t in b:
        plus, minus, up, down = _next_row(where.get(t, 0), plus, minus, full)
        score += bool(up & last) - bool(down & last)
    return score


def align_tokens(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment of fewest insertions, deletions and replacements: pairs in order, None for a gap. As in ``_align``,
    every k-th row is kept and the rows between are made again on the way back."""
    lo, hi = _ends(a, b)
    i, j = len(a) - hi, len(b) - hi
    pairs: list[tuple[int | None, int | None]] = [(i + k, j + k) for k in range(hi - 1, -1, -1)]
    if i > lo and j > lo:
        where, full, every = _places(a[lo:i]), (1 << (i - lo)) - 1, max(1, isqrt(j - lo))
        kept = [(full, 0)]
        row = kept[0]
        for k in range(lo, j):
            row = _next_row(where.get(b[k], 0), *row, full)[:2]
            if (k - lo + 1) % every == 0:
                kept.append(row)
        while i > lo and j > lo:
            low = (j - lo - 1) // every
            rows = [kept[low]]
            low = lo + low * every
            for k in range(low, j):
                rows.append(_next_row(where.get(b[k], 0), *rows[-1], full)[:2])
            while i > lo and j > low:
                if rows[j - low][0] >> (i - lo - 1) & 1:
                    i -= 1
                    pairs.append((i, None))
                else:
                    j -= 1
                    if rows[j - low][1] >> (i - lo - 1) & 1:
                        pairs.append((None, j))
                    else:
                        i -= 1
                        pairs.append((i, j))
    pairs += [(k, None) for k in range(i - 1, lo - 1, -1)] + [(None, k) for k in range(j - 1, lo - 1, -1)]
    return [(k, k) for k in range(lo)] + pairs[::-1]


def _led(profile: Ranked) -> tuple[list[str], list[Ranked]]:
    """Leading tokens, and the columns led by a gap before each of them and at the end."""
    led, between = [], [[]]
    for t, w in profile:
        if t is None:
            between[-1].append((t, w))
        else:
            led.append((t, w))
            between.append([])
    return led, between


def merge_ranked(one: Ranked, total_one: int, two: Ranked, total_two: int) -> Ranked:
    """Two profiles aligned to each other, the heavier vote leading each column; ``total``: the highest weight of a profile.

    A column led by a gap disagrees with every token, as a gap of the other profile would: such columns are left out of the
    alignment and then take the tokens that stand alone at their place, so that the number of columns stays small.
    """
    (a, gaps_a), (b, gaps_b) = _led(one), _led(two)
    none_a, none_b = (None, total_one), (None, total_two)
    heavier = lambda x, y: x if x[1] >= y[1] else y
    out, alone_a, alone_b = [], [], []
    for i, j in [*align_tokens([t for t, _ in a], [t for t, _ in b]), (len(a), len(b))]:
        alone_a += gaps_a[i] if i is not None else []
        alone_b += gaps_b[j] if j is not None else []
        if i is None:
            alone_b.append(b[j])
            continue
        out += [heavier(x or none_a, y or none_b) for x, y in zip_longest(alone_a, alone_b)]
        alone_a, alone_b = [], []
        if i < len(a):
            out.append(heavier(a[i], b[j] if j is not None else none_b))
    return out


def ranked_profile(weighted: list[tuple[str, int]]) -> tuple[Ranked, int]:
    """(profile, highest weight) of values each of which outweighs all lighter ones, aligned progressively, heaviest first."""
    profile, total = [], None
    for value, weight in sorted(weighted, key=lambda x: (-x[1], x[0])):
        single = [(t, weight) for t in tokens(value)]
        profile = single if total is None else merge_ranked(profile, total, single, weight)
        total = weight if total is None else max(total, weight)
    return profile, total


def ranked_vote(profile: Ranked) -> list[str]:
    """The leading token of each column; gaps give none."""
    return [t for t, _ in profile if t is not None]


def weight_of(rank: dict) -> int:
    """The place of a rank in the order of all ranks; no id is below every id."""
    t, w, i = (rank[k] if rank[k] is not None else -(2**63) - 1 for k in "twi")
    return (t * 2**65 + w) * 2**65 + i


def closest(weighted: list[tuple[str, int]], precedence: bool = False) -> int:
    """Position of the existing value closest to the consensus; among equals the heaviest, then the smallest. Under
    ``precedence`` a value outweighs all lighter ones together."""
    if precedence:
        target = ranked_vote(ranked_profile(weighted)[0])
    else:
        top = max(range(len(weighted)), key=lambda k: weighted[k][1])
        if 2 * weighted[top][1] > sum(w for _, w in weighted):  # the majority of every column
            return top
        target = consensus(weighted)
    return min(range(len(weighted)), key=lambda k: (distance(tokens(weighted[k][0]), target), -weighted[k][1], weighted[k][0]))


def _weights(ranks_or_votes: list, precedence: bool) -> list[int]:
    return [weight_of(r) for r in ranks_or_votes] if precedence else ranks_or_votes


def _reduce_batches(keys: list[str], precedence: bool):
    """The winner of each row's items; only rows of several items are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            winners = np.cumsum(sizes) - sizes
            texts, weights = flat.field("value"), flat.field("rank" if precedence else "votes")
            for k in np.flatnonzero(sizes > 1):
                at, n = int(winners[k]), int(sizes[k])
                own = _weights(weights.slice(at, n).to_pylist(), precedence)
                winners[k] += closest(list(zip(texts.slice(at, n).to_pylist(), own, strict=True)), precedence)
            won = flat.take(pa.array(winners))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *won.flatten()], [*keys, *(f.name for f in flat.type)])

    return run


_ITEM = "value string, rank struct<t:bigint,w:bigint,i:bigint>, votes bigint"


def _reduced(values: DataFrame, keys: list[str], precedence: bool) -> DataFrame:
    packed = values.groupBy(*keys).agg(F.collect_list(F.struct("value", "rank", "votes")).alias("items"))
    return packed.mapInArrow(_reduce_batches(keys, precedence), ", ".join(f"{k} string" for k in keys) + ", " + _ITEM)


def _packed(profile: Profile | Ranked, precedence: bool) -> str:
    return json.dumps(profile if precedence else [[[t, w] for t, w in c.items()] for c in profile], ensure_ascii=False)


def _unpacked(text: str, precedence: bool) -> Profile | Ranked:
    return [(t, w) for t, w in json.loads(text)] if precedence else [{t: w for t, w in c} for c in json.loads(text)]


def _profile_batches(keys: list[str], leaves: bool, precedence: bool):
    """One profile per row of ``items``: values with weights (leaves) or profiles with totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals = [], []
            for items in batch.column("items"):
                items = items.as_py()
                if leaves:
                    weighted = list(zip([x["value"] for x in items], _weights([x["weight"] for x in items], precedence), strict=True))
                    profile, total = (ranked_profile if precedence else profile_of)(weighted)
                else:
                    profile, total = [], None
                    for own, text in sorted(((int(x["total"]), x["profile"]) for x in items), key=lambda x: (-x[0], x[1])):
                        other = _unpacked(text, precedence)
                        if total is None:
                            profile, total = other, own
                        elif precedence:
                            profile, total = merge_ranked(profile, total, other, own), max(total, own)
                        else:
                            profile, total = merge(profile, total, other, own), total + own
                texts.append(_packed(profile, precedence))
                totals.append(str(total))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string()), pa.array(totals, pa.string())], [*keys, "profile", "total"])

    return run


def _vote_batches(keys: list[str], precedence: bool):
    """The consensus of each profile, as a list in JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            profiles = (_unpacked(text.as_py(), precedence) for text in batch.column("profile"))
            targets = [json.dumps((ranked_vote if precedence else voted)(p), ensure_ascii=False) for p in profiles]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(targets, pa.string())], [*keys, "target"])

    return run


def _distance_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, target = None, []
    for batch in batches:
        far = []
        for text, value in zip(batch.column("target"), batch.column("value"), strict=True):
            text = text.as_py()
            if text != last:
                last, target = text, json.loads(text)
            far.append(distance(tokens(value.as_py()), target))
        rest = batch.drop_columns(["target"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(far, pa.int64())], [*rest.schema.names, "far"])


def _voted_large(values: DataFrame, keys: list[str], fan_in: int, precedence: bool) -> DataFrame:
    """Winners of groups too large for one row, by profiles merged in a tree. ``values`` has ``_n`` per group."""
    names = ", ".join(f"{k} string" for k in keys)
    schema = names + ", bucket bigint, profile string, total string"
    width = lambda n: F.ceil(F.col(n) / F.lit(fan_in))
    spread = values.withColumn("bucket", F.pmod(F.xxhash64("value"), width("_n")))
    weight = F.col("rank" if precedence else "votes").alias("weight")
    profiles = durable(
        spread.groupBy(*keys, "bucket").agg(F.collect_list(F.struct("value", weight)).alias("items"))
        .mapInArrow(_profile_batches([*keys, "bucket"], True, precedence), schema)
    )
    while not profiles.where("bucket > 0").isEmpty():
        up = profiles.withColumn("bucket", F.floor(F.col("bucket") / F.lit(max(2, fan_in))))
        wider = durable(
            up.groupBy(*keys, "bucket").agg(F.collect_list(F.struct("profile", "total")).alias("items"))
            .mapInArrow(_profile_batches([*keys, "bucket"], False, precedence), schema)
        )
        release(profiles)
        profiles = wider
    targets = profiles.select(*keys, "profile").mapInArrow(_vote_batches(keys, precedence), names + ", target string")
    compared = values.drop("_n").join(targets, keys).mapInArrow(_distance_batches, names + ", " + _ITEM + ", far bigint")
    won = F.struct("value", "rank", "votes")
    if precedence:
        best = F.max_by(won, F.struct((-F.col("far")).alias("near"), "rank"))
    else:
        best = F.min_by(won, F.struct("far", (-F.col("votes")).alias("light"), "value"))
    return compared.groupBy(*keys).agg(best.alias("_w")).select(*keys, "_w.value", "_w.rank", "_w.votes")


def has_value(c: Column) -> Column:
    """The text of ``c``, NULL if it is blank, 0, ``[]``, ``{}`` or ``null``."""
    bare = F.lower(F.regexp_replace(c.cast("string"), "\\s+", ""))
    return F.when(~bare.isin("", "0", "[]", "{}", "null"), c.cast("string"))


def representatives(
    records: DataFrame, group: Column, record_id: str, fields: list[str], trust: Column, when: Column, *,
    least_records: int = 2, weighting: str = "precedence", fan_in: int = FAN_IN,
) -> DataFrame:
    """(group_key, first_rec_id, field_name, rec_id, value): the surviving value of each field of each group.

    ``group``: one text per group, NULL for records without one. ``trust``, ``when``: longs, NULL counts as
    0 and as earliest. Groups with fewer than ``least_records`` records give no rows.
    """
    precedence = {"precedence": True, "votes": False}[weighting]
    rank = F.struct(
        F.coalesce(trust, F.lit(0)).cast("long").alias("t"), F.coalesce(when, F.lit(-(2**62))).cast("long").alias("w"),
        F.col(record_id).cast("long").alias("i"),
    )
    base = records.select(
        group.alias("group_key"), rank.alias("rank"),
        F.array(*[F.struct(F.lit(f).alias("field_name"), has_value(F.col(f)).alias("value")) for f in fields]).alias("cells"),
    ).where("group_key is not null")
    groups = base.groupBy("group_key").agg(F.min("rank.i").alias("first_rec_id"), F.count("*").alias("_n")).where(F.col("_n") >= least_records).drop("_n")
    cells = base.select("group_key", "rank", F.inline("cells")).where("value is not null")
    values = durable(
        cells.groupBy("group_key", "field_name", "value").agg(F.max("rank").alias("rank"), F.sum(F.greatest(F.col("rank.t"), F.lit(1))).alias("votes"))
    )
    keys = ["group_key", "field_name"]
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > fan_in)
    if sizes.isEmpty():
        won = _reduced(values, keys, precedence)
    else:  # only the large groups go through profiles
        won = _reduced(values.join(sizes.select(*keys), keys, "left_anti"), keys, precedence)
        won = won.unionByName(_voted_large(durable(values.join(sizes, keys)), keys, fan_in, precedence))
    return won.join(groups, "group_key").select("group_key", "first_rec_id", "field_name", F.col("rank.i").alias("rec_id"), "value")
