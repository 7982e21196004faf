"""Problem 1: timestamps of many spellings, precisions and zones as one UTC instant.

One regular expression holds every format as an alternation with named groups. Its components are
extracted by a single replacement (one regex pass per value), checked against the calendar, and the
instant is assembled from integer day numbers; no format is tried twice and no row leaves the JVM.

Defined results: NULL, empty, blank and unreadable texts, impossible dates, a bare 0, readings
without offset whose zone is unknown, and readings that the zone's clock shows twice or never give
NULL. A written offset outranks a zone beside it. Digits finer than a microsecond are cut off.
"""

from __future__ import annotations

import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.keys import task_key

DAY = 86_400_000_000
_SEP = "\x01"

# Month names, zone abbreviations that mean one offset (in minutes), range of Unix times.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "aest": 600, "aedt": 660,
}
UNIX_RANGE = (1_672_531_200, 1_798_761_600)

CANONICAL = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{6}Z$"

_MON = "(?:" + "|".join(MONTHS) + ")[a-z]*"
_DATES = (
    "(?<isoyear>\\d{4})-(?<isomonth>\\d{1,2})-(?<isoday>\\d{1,2})",
    "(?<ordyear>\\d{4})-(?<ordday>\\d{3})",
    f"(?:[a-z]{{3,9}},?\\s+)?(?<mailday>\\d{{1,2}})[\\s-](?<mailmonth>{_MON})[\\s-](?<mailyear>\\d{{4}})",
    f"(?<logday>\\d{{1,2}})/(?<logmonth>{_MON})/(?<logyear>\\d{{4}})",
    "(?<usmonth>\\d{1,2})/(?<usday>\\d{1,2})/(?<usyear>\\d{4})",
    "(?<dotday>\\d{1,2})\\.(?<dotmonth>\\d{1,2})\\.(?<dotyear>\\d{4})",
)
_CLOCK = "(?<hour>\\d{1,2}):(?<minute>\\d{2})(?::(?<second>\\d{2})(?:[.,](?<fraction>\\d+))?)?(?:\\s*(?<half>am|pm)(?![a-z]))?"
_BASIC = (
    "(?<basyear>\\d{4})(?<basmonth>\\d{2})(?<basday>\\d{2})"
    "t(?<bashour>\\d{2})(?<basminute>\\d{2})(?:(?<bassecond>\\d{2})(?:[.,](?<basfraction>\\d+))?)?"
)
_ZONE = (
    "(?:\\s*(?<sign>[+-])(?<offhour>\\d{2})(?::?(?<offminute>\\d{2}))?)?"
    "(?:\\s*\\[?(?<zone>[a-z][a-z0-9_+-]*(?:/[a-z0-9_+-]+)*)\\]?)?"
)
_UNIX = "(?<unix>\\d{9,19})(?:\\.(?<unixfraction>\\d*))?"
PATTERN = (
    f"(?is)^\\s*(?:(?:(?:{'|'.join(_DATES)})(?:(?:t|:|,?\\s+){_CLOCK})?|{_BASIC}){_ZONE}|{_UNIX})\\s*$"
)
_GROUPS = (
    "isoyear isomonth isoday ordyear ordday mailday mailmonth mailyear logday logmonth logyear usmonth usday usyear "
    "dotday dotmonth dotyear hour minute second fraction half basyear basmonth basday bashour basminute bassecond "
    "basfraction sign offhour offminute zone unix unixfraction"
).split()


@functools.lru_cache(maxsize=4)
def _zones_of(names: str) -> tuple[str, ...]:
    return tuple(sorted(x for x in names.strip("[]").split(", ") if x and not x.startswith("SystemV")))


def known_zones(spark: SparkSession | None = None) -> tuple[str, ...]:
    """Zone names the JVM can convert (about 600, a property of the zone database, not of the data)."""
    spark = spark or SparkSession.getActiveSession()
    try:
        return _zones_of(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString())
    except Exception:  # a session without a JVM handle
        return tuple(sorted(zoneinfo.available_timezones()))


def components(text: Column) -> Column:
    """Struct of the named groups, by one pass of the pattern; NULL where no format fits."""
    split = F.split(
        F.regexp_replace(text, PATTERN, _SEP + _SEP.join("${%s}" % g for g in _GROUPS)), _SEP
    )
    fits = ~F.contains(text, F.lit(_SEP)) & (F.size(split) == len(_GROUPS) + 1)
    return F.when(fits, split)


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers.

    Years are counted from March, so that the leap day is a year's last: 365 days a year, a leap day
    every 4th but not every 100th except every 400th, and (153 m + 2) / 5 days before the m-th month.
    """
    y = year - F.when(month <= 2, 1).otherwise(0)
    m = month + F.when(month > 2, -3).otherwise(9)
    whole = lambda a, n: F.call_function("div", a, F.lit(n))  # noqa: E731  (years and months are not negative)
    return y * 365 + whole(y, 4) - whole(y, 100) + whole(y, 400) + whole(m * 153 + 2, 5) + day - 1 - 719_468


def _month_days(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return (
        F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    )


def _micros_of(fraction: Column) -> Column:
    return F.rpad(fraction, 6, "0").cast("long")


def with_parts(df: DataFrame, text: str, out: str = "_p") -> DataFrame:
    """``df`` with ``out``: struct(local long, utc long, zone string) of column ``text``.

    ``utc`` is set where the text itself fixes the instant (offset, abbreviation, Unix time); else
    ``local`` is the wall clock as microseconds and ``zone`` the zone the text names, if any.
    """
    raw, c = f"{out}_raw", f"{out}_c"
    df = df.withColumn(raw, components(F.col(text)))
    at = {g: F.nullif(F.col(raw)[i + 1], F.lit("")) for i, g in enumerate(_GROUPS)}
    num = lambda *names: F.coalesce(*[at[n] for n in names]).cast("int").cast("long")
    named = F.lower(F.substring(F.coalesce(at["mailmonth"], at["logmonth"]), 1, 3))
    by_name = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), named), F.lit(0).cast("long"))
    df = df.withColumn(
        c,
        F.when(
            F.col(raw).isNotNull(),
            F.struct(
                num("isoyear", "ordyear", "mailyear", "logyear", "usyear", "dotyear", "basyear").alias("y"),
                F.coalesce(num("isomonth", "usmonth", "dotmonth", "basmonth"), by_name, F.lit(1)).alias("mo"),
                F.coalesce(num("isoday", "mailday", "logday", "usday", "dotday", "basday"), F.lit(1)).alias("d"),
                num("ordday").alias("doy"),
                F.coalesce(num("hour", "bashour"), F.lit(0)).alias("h"),
                F.coalesce(num("minute", "basminute"), F.lit(0)).alias("mi"),
                F.coalesce(num("second", "bassecond"), F.lit(0)).alias("s"),
                F.coalesce(_micros_of(F.coalesce(at["fraction"], at["basfraction"])), F.lit(0)).alias("us"),
                F.lower(at["half"]).alias("half"),
                at["sign"].alias("sign"),
                num("offhour").alias("oh"),
                F.coalesce(num("offminute"), F.lit(0)).alias("om"),
                at["zone"].alias("zone"),
                at["unix"].alias("unix"),
                F.rpad(F.coalesce(at["unixfraction"], F.lit("")), 6, "0").alias("unixfraction"),
            ),
        ),
    )
    p = lambda f: F.col(f"{c}.{f}")

    # Unix times: the unit is the one that puts the value into the fixed range.
    lo, hi = UNIX_RANGE
    n = F.expr(f"try_cast({c}.unix as bigint)")
    within = lambda k: n.between(lo * k, hi * k - 1)
    unix = (
        F.when(within(1), n * 1_000_000 + p("unixfraction").cast("long"))
        .when(within(1_000), n * 1_000 + F.substring(p("unixfraction"), 1, 3).cast("long"))
        .when(within(1_000_000), n)
        .when(within(1_000_000_000), F.substring(p("unix"), 1, 16).cast("long"))
    )

    hour = F.when(p("half").isNull(), p("h")).otherwise(p("h") % 12 + F.when(p("half") == "pm", 12).otherwise(0))
    hour_ok = F.when(p("half").isNull(), p("h") <= 23).otherwise(p("h").between(1, 12))
    leap = (p("y") % 4 == 0) & ((p("y") % 100 != 0) | (p("y") % 400 == 0))
    day_ok = F.when(
        p("doy").isNotNull(), p("doy").between(1, F.when(leap, 366).otherwise(365))
    ).otherwise(p("mo").between(1, 12) & p("d").between(1, _month_days(p("y"), p("mo"))))
    valid = (p("y") >= 1) & day_ok & hour_ok & (p("mi") <= 59) & (p("s") <= 59)
    day = day_number(p("y"), p("mo"), p("d")) + F.coalesce(p("doy") - 1, F.lit(0))
    # Each step is a column of its own: one that is used again is computed once, and code stays short.
    at_local, at_short, at_unix = f"{out}_local", f"{out}_short", f"{out}_unix"
    df = df.withColumns({
        at_local: F.when(valid, day * DAY + ((hour * 60 + p("mi")) * 60 + p("s")) * 1_000_000 + p("us")),
        at_short: F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.lower(p("zone"))),
        at_unix: unix,
    })
    local, short = F.col(at_local), F.col(at_short)
    minutes = F.when(p("oh").between(0, 18) & (p("om") <= 59), (p("oh") * 60 + p("om")) * F.when(p("sign") == "-", -1).otherwise(1))
    utc = F.when(p("unix").isNotNull(), F.col(at_unix)).when(
        p("sign").isNotNull(), local - minutes.cast("long") * 60_000_000
    ).when(short.isNotNull(), local - short.cast("long") * 60_000_000)
    open_ = p("unix").isNull() & p("sign").isNull() & short.isNull()
    return df.withColumn(
        out, F.struct(F.when(open_, local).alias("local"), utc.alias("utc"), F.when(open_, p("zone")).alias("zone"))
    ).drop(raw, c, at_local, at_short, at_unix)


def resolve_local(df: DataFrame, local: Column, zone: Column, zones: tuple[str, ...], out: str) -> DataFrame:
    """``df`` with ``out``: UTC microseconds of a wall clock reading.

    NULL if the zone is unknown or its clock shows the reading twice or never. The offsets a day before
    and a day after the reading are the only candidates; the reading is unambiguous when exactly one
    instant, by either of them, shows it.
    """
    at, safe, a, b, sa, sb = (f"{out}_{x}" for x in ("at", "safe", "a", "b", "sa", "sb"))
    offset = lambda x: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(x), F.col(safe))) - x
    shows = lambda u: F.coalesce(F.col(u) + offset(F.col(u)) == F.col(at), F.lit(False))
    known = F.when(zone.isin(*zones) | zone.rlike("^[+-](0\\d|1[0-8]):[0-5]\\d$"), zone)
    df = df.withColumns({at: local, safe: known})
    df = df.withColumns({a: F.col(at) - offset(F.col(at) - DAY), b: F.col(at) - offset(F.col(at) + DAY)})
    df = df.withColumns({sa: shows(a), sb: shows(b)})
    one = F.when(F.col(sa) & (~F.col(sb) | (F.col(a) == F.col(b))), F.col(a)).when(F.col(sb) & ~F.col(sa), F.col(b))
    return df.withColumn(out, one).drop(at, safe, a, b, sa, sb)


def task_zones(clocks: DataFrame) -> DataFrame:
    """(zone_task, zone_name): the one zone of each task; tasks with none or several are left out."""
    return (
        clocks.select(task_key("task_id").alias("zone_task"), F.nullif(F.trim("zone_name"), F.lit("")).alias("z"))
        .where("zone_task is not null and z is not null")
        .groupBy("zone_task")
        .agg(F.min("z").alias("zone_name"), F.max("z").alias("_z"))
        .where("zone_name = _z")
        .select("zone_task", "zone_name")
    )


def normalise(df: DataFrame, fields: dict[str, str], task: str, clocks: DataFrame) -> DataFrame:
    """``df`` with one long column of UTC microseconds per entry of ``fields`` (text column -> new column).

    ``task`` names the column whose key finds the zone in ``clocks``. The clocks are joined once for all
    fields, by an equi-join whose side Spark sizes at run time; rows without a task meet no clock.
    Existing columns are kept; a column named like a new one is replaced.
    """
    zones = known_zones(df.sparkSession)
    for k, text in enumerate(fields):
        df = with_parts(df, text, f"_ls_p{k}")
    df = df.withColumn("_ls_zone_task", task_key(task))
    names = task_zones(clocks).select(F.col("zone_task").alias("_ls_zone_task"), F.col("zone_name").alias("_ls_zone_name"))
    df = df.join(names, "_ls_zone_task", "left")
    for k, out in enumerate(fields.values()):
        p = F.col(f"_ls_p{k}")
        df = resolve_local(df, p["local"], F.coalesce(p["zone"], F.col("_ls_zone_name")), zones, f"_ls_u{k}")
    # The results pass through a generator: a filter on them is then not pushed below the parsing, where
    # the whole expression would be evaluated once more.
    one = F.struct(*[F.coalesce(F.col(f"_ls_p{k}.utc"), F.col(f"_ls_u{k}")).alias(f"r{k}") for k in range(len(fields))])
    helpers = [x for k in range(len(fields)) for x in (f"_ls_p{k}", f"_ls_u{k}")]
    df = df.withColumn("_ls_out", F.explode(F.array(one)))
    for k, out in enumerate(fields.values()):
        df = df.withColumn(out, F.col(f"_ls_out.r{k}"))
    return df.drop("_ls_zone_task", "_ls_zone_name", "_ls_out", *helpers)


def found(sources: list[tuple[str, DataFrame, str, str]], clocks: DataFrame) -> DataFrame:
    """Distinct (src_table, rec_key, utc_micros) of values that name an instant but are not canonical.

    ``sources``: (table name, frame with task_id, key column, text column).
    """
    parts = None
    for name, df, key, text in sources:
        one = df.select(
            F.lit(name).alias("src_table"), F.col(key).alias("rec_key"), F.col("task_id"), F.col(text).alias("raw")
        ).where(F.col("raw").isNotNull() & ~F.col("raw").rlike(CANONICAL) & F.col("raw").rlike("[0-9]{4}"))
        parts = one if parts is None else parts.unionAll(one)
    return (
        normalise(parts, {"raw": "utc_micros"}, "task_id", clocks)
        .where("utc_micros is not null")
        .select("src_table", "rec_key", "utc_micros")
        .distinct()
    )
