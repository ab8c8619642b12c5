"""Mixed timestamp formats and zones to one UTC instant, inside the JVM.

Each value is matched against a list of formats by anchored regular expressions that yield local
date-time parts and, where given, an offset, an abbreviation or a zone name. Local times are resolved
by an as-of join with the zone's exploded offset intervals, keyed on (zone, local year): two matching
intervals mean ambiguous (the earlier instant is taken), none means skipped (the offset in force
before the change is taken), one gives the offset. The intervals table is bounded by the time-zone
database, not by the data, so it is the broadcast side.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets in minutes of North American, European and Japanese zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# Month names of the supported languages, full and abbreviated, lower case.
MONTHS = [
    "jan january januar januari janv janvier enero ene janeiro jänner января янв ιανουαρίου ιαν".split(),
    "feb february februar février fevrier févr fév febrero fevereiro fev февраля фев φεβρουαρίου φεβ".split(),
    "mar march märz mär mars marzo março marco марта мар μαρτίου μαρ".split(),
    "apr april avril avr abril abr апреля апр απριλίου απρ".split(),
    "may mai mayo maio мая май μαΐου μάι μαϊ".split(),
    "jun june juni juin junio junho июня июн ιουνίου ιουν".split(),
    "jul july juli juillet juil julio julho июля июл ιουλίου ιουλ".split(),
    "aug august août aout agosto ago августа авг αυγούστου αυγ".split(),
    "sep sept september septembre septiembre setembro set сентября сен сент σεπτεμβρίου σεπ".split(),
    "oct october oktober okt octobre octubre outubro out октября окт οκτωβρίου οκτ".split(),
    "nov november novembre noviembre novembro ноября ноя нояб νοεμβρίου νοε".split(),
    "dec december dezember dez décembre decembre déc diciembre dic dezembro декабря дек δεκεμβρίου δεκ".split(),
]

DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?"
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
TAIL = r"\s*([ap]\.?m\.?(?![a-z]))?\s*(z|[+\-−]\d{2}:?\d{2}|[+\-−]\d{2}|[a-z]{2,4}|[a-z]+(?:/[a-z0-9_+\-]+)+)?"
WORD = r"([\p{L}]+)\.?"

# name: (pattern, groups holding year, month, day); the clock is groups 4 to 9 of every pattern that has one.
FORMATS = {
    "ymd": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[t\s]\s*{CLOCK}{TAIL})?$", (1, 3, 4), 5),
    "compact": (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()(z|[+\-−]\d{2}:?\d{2}|[+\-−]\d{2})?$", (1, 2, 3), 4),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{CLOCK}{TAIL})?$", (3, 2, 1), 4),
    "slash": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{CLOCK}{TAIL})?$", (3, 0, 0), 4),
    "day_name": (rf"^(?:{DAY}\s+)?(\d{{1,2}})(?:st|nd|rd|th|º|\.)?\s*(?:de\s+)?{WORD},?\s+(?:de\s+)?(\d{{4}})(?:,?\s+(?:at\s+)?{CLOCK}{TAIL})?$", (3, 2, 1), 4),
    "name_day": (rf"^(?:{DAY}\s+)?{WORD}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{CLOCK}{TAIL})?$", (3, 1, 2), 4),
    "ctime": (rf"^{DAY}\s+{WORD}\s+(\d{{1,2}})\s+{CLOCK}(?:\s+([a-z]{{2,4}}))?\s+(\d{{4}})$", (8, 1, 2), 3),
    "cjk": (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日(?:\s*{CLOCK}{TAIL})?$", (1, 2, 3), 4),
}

SECOND = 1_000_000
CENTURY = (946_684_800, 4_102_444_800)


@lru_cache(maxsize=1)
def zone_intervals() -> list[tuple[str, list[tuple[int, int]]]]:
    """(zone, [(first UTC second, offset in seconds], ...]) for every named zone from 1970 to 2045.
    Offsets are probed a week apart and each change is located by bisection."""
    start, end, step = 0, 2_366_841_600, 7 * 86_400
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    out = []
    for name in sorted(zoneinfo.available_timezones()):
        if name in ("localtime", "posixrules", "Factory"):
            continue
        zone = zoneinfo.ZoneInfo(name)

        def offset(s: int) -> int:
            return int((epoch + dt.timedelta(seconds=s)).astimezone(zone).utcoffset().total_seconds())

        spans, last = [(-(1 << 40), offset(start))], offset(start)
        for s in range(start + step, end, step):
            now = offset(s)
            if now != last:
                lo, hi = s - step, s
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == last else (lo, mid)
                spans.append((hi, now))
                last = now
        out.append((name, spans))
    return out


def offset_intervals(spark: SparkSession) -> DataFrame:
    """One row for each zone and local year: the intervals that touch it, as local start, local end and offset.
    At most (named zones) x (years) rows; rows outside 1970 to 2045 use the first or last interval."""
    rows = [(z, [s for s, _ in spans], [o for _, o in spans]) for z, spans in zone_intervals()]
    base = spark.createDataFrame(rows, "zone string, starts array<bigint>, offsets array<bigint>")
    spans = base.select(
        F.lower("zone").alias("zone"),
        F.expr("""explode(transform(sequence(0, size(starts) - 1), i -> named_struct(
            'since', starts[i] + offsets[i], 'until', coalesce(get(starts, i + 1), 1L << 40) + offsets[i],
            'off', offsets[i], 'before', coalesce(get(offsets, i - 1), offsets[i]))))""").alias("s"),
    )
    year = lambda c: F.year(F.timestamp_seconds(F.greatest(F.lit(-62_135_000_000), F.least(F.lit(253_370_000_000), c))))
    low, high = F.greatest(year(F.col("s.since")), F.lit(1969)), F.least(year(F.col("s.until")), F.lit(2046))
    return (
        spans.select("zone", "s", F.explode(F.sequence(low, F.greatest(low, high))).alias("span_year"))
        .groupBy("zone", "span_year")
        .agg(F.sort_array(F.collect_list("s")).alias("spans"))
    )


def _local_parts(v: Column, order: Column) -> Column:
    """struct(y, mo, d, h, mi, s, frac, ampm, zone) of the first format that matches, else NULL."""
    names = {m: i + 1 for i, ms in enumerate(MONTHS) for m in ms}
    month = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    chain = None
    for name, (pattern, (gy, gm, gd), clock) in FORMATS.items():
        g = lambda i, p=pattern: F.regexp_extract(v, p, i)
        num = lambda c: c.try_cast("int")
        if name == "slash":
            first, second = num(g(1)), num(g(2))
            mo, d = F.when(order == "mdy", first).otherwise(second), F.when(order == "mdy", second).otherwise(first)
        elif name in ("day_name", "name_day", "ctime"):
            mo, d = F.try_element_at(month, g(gm)), num(g(gd))
        else:
            mo, d = num(g(gm)), num(g(gd))
        ampm, zone = (F.lit(""), g(7)) if name == "ctime" else (g(clock + 4), g(clock + 5))
        part = F.struct(
            num(g(gy)).alias("y"), mo.alias("mo"), d.alias("d"), num(g(clock)).alias("h"), num(g(clock + 1)).alias("mi"), num(g(clock + 2)).alias("s"), g(clock + 3).alias("frac"), ampm.alias("ampm"), zone.alias("zone")
        )
        hit = F.regexp_like(v, F.lit(pattern))
        chain = F.when(hit, part) if chain is None else chain.when(hit, part)
    return chain


def _bare_number(v: Column) -> Column:
    """Microseconds of a bare number in seconds, milli-, micro- or nanoseconds, whichever gives this century."""
    whole, frac = F.regexp_extract(v, r"^(\d+)(?:\.(\d+))?$", 1), F.regexp_extract(v, r"^(\d+)(?:\.(\d+))?$", 2)
    n = whole.try_cast("decimal(30,0)")
    digits = F.rpad(F.substring(frac, 1, 6), 6, "0").try_cast("bigint")
    out = None
    for unit, per in ((1, 1_000_000), (1_000, 1_000), (1_000_000, 1), (1_000_000_000, 0)):
        inside = (n >= F.lit(CENTURY[0]).cast("bigint") * unit) & (n < F.lit(CENTURY[1]).cast("bigint") * unit)
        micros = (n * per).cast("bigint") if per else F.floor(n / 1000).cast("bigint")
        extra = digits if unit == 1 else F.when(F.lit(unit == 1000), F.substring(F.rpad(frac, 3, "0"), 1, 3).try_cast("bigint")).otherwise(F.lit(0))
        value = micros + F.coalesce(extra, F.lit(0))
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out


def normalise_timestamps(df: DataFrame, value: str, locales: DataFrame, locale: str, out: str = "utc_us") -> DataFrame:
    """df with column `out`: the instant `value` names, in microseconds since 1970 UTC, or NULL.

    `locales` has (page_lang, zone_name, date_order); a row whose `locale` isn't there, is NULL or empty reads zoneless
    values as UTC and slash dates as day/month/year. NULL, empty, vague, relative and impossible values give NULL.
    Row count and the other columns are kept; df may hold columns of any other names. Rows with equal
    values get equal results; the order of rows doesn't matter.
    """
    spark = df.sparkSession
    tags = locales.where("page_lang is not null").groupBy(F.col("page_lang").alias("__tag")).agg(F.min(F.struct("zone_name", "date_order")).alias("__loc"))
    base = df.join(tags, df[locale] == tags["__tag"], "left").drop("__tag")
    v = F.lower(F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", ""))
    base = base.withColumn("__v", v)
    day = r"^(\d{4})(\d{2})(\d{2})$"
    base = base.withColumn(
        "__v", F.when(F.regexp_like("__v", F.lit(day)), F.regexp_replace("__v", day, "$1-$2-$3")).otherwise(F.col("__v"))
    ).withColumn("__p", _local_parts(F.col("__v"), F.col("__loc.date_order")))
    p = lambda k: F.col(f"__p.{k}")
    ampm = F.regexp_replace(p("ampm"), r"\.", "")
    h = F.when(F.coalesce(ampm, F.lit("")) == "", F.coalesce(p("h"), F.lit(0))).when(p("h").between(1, 12), p("h") % 12 + F.when(ampm == "pm", 12).otherwise(0))
    mi, s = F.coalesce(p("mi"), F.lit(0)), F.coalesce(p("s"), F.lit(0))
    date = F.expr("try_make_timestamp_ntz(__p.y, __p.mo, __p.d, 0, 0, 0)").cast("date")
    seconds = F.unix_date(date).cast("bigint") * 86_400 + h * 3600 + mi * 60 + s
    local = F.when((h < 24) & (mi < 60) & (s < 60), seconds)
    micros = F.coalesce(F.rpad(F.substring(p("frac"), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    sign = F.when(F.regexp_like(p("zone"), F.lit("^[-−]")), -1).otherwise(1)
    nums = F.regexp_replace(p("zone"), "[^0-9]", "")
    oh, om = F.substring(nums, 1, 2).try_cast("int"), F.coalesce(F.substring(nums, 3, 2).try_cast("int"), F.lit(0))
    abbr = F.create_map(*[F.lit(x) for k, o in ABBREVIATIONS.items() for x in (k.lower(), o * 60)])
    fixed = F.when(F.regexp_like(p("zone"), F.lit("^[+\\-−]")), F.when((oh <= 18) & (om < 60), sign * (oh * 3600 + om * 60))).otherwise(F.try_element_at(abbr, p("zone")))
    named = F.coalesce(p("zone"), F.lit("")) != ""
    zone = F.when(named, F.when(F.contains(p("zone"), F.lit("/")), p("zone"))).otherwise(F.lower(F.coalesce(F.nullif(F.col("__loc.zone_name"), F.lit("")), F.lit("utc"))))
    base = base.withColumns({"__local": local, "__us": micros, "__fixed": fixed.cast("bigint"), "__zone": zone, "__bare": _bare_number(F.col("__v"))})
    base = base.withColumn("__year", F.least(F.greatest(F.col("__p.y"), F.lit(1969)), F.lit(2046)))
    spans = offset_intervals(spark).select(F.col("zone").alias("__z"), F.col("span_year").alias("__y"), F.col("spans").alias("__spans"))
    joined = base.join(F.broadcast(spans), (base["__zone"] == spans["__z"]) & (base["__year"] == spans["__y"]), "left")
    hits = F.expr("filter(__spans, x -> __local >= x.since and __local < x.until)")
    gap = F.expr("element_at(filter(__spans, x -> __local < x.since), 1).before")
    offset = F.when(F.size(hits) > 0, F.array_max(F.transform(hits, lambda x: x["off"]))).otherwise(gap)
    instant = F.when(F.col("__fixed").isNotNull(), F.col("__local") - F.col("__fixed")).when(F.col("__zone").isNotNull(), F.col("__local") - offset)
    result = F.coalesce(F.col("__bare"), instant * SECOND + F.col("__us"))
    return joined.withColumn(out, result).drop("__loc", "__v", "__p", "__local", "__us", "__fixed", "__zone", "__bare", "__year", "__z", "__y", "__spans")
