"""Times as people and systems write them, normalised to exact UTC instants."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, English and German, full and as abbreviated.
_MONTHS = {
    1: ("january", "jan", "januar"),
    2: ("february", "feb", "februar"),
    3: ("march", "mar", "märz", "maerz", "mrz"),
    4: ("april", "apr"),
    5: ("may", "mai"),
    6: ("june", "jun", "juni"),
    7: ("july", "jul", "juli"),
    8: ("august", "aug"),
    9: ("september", "sep", "sept"),
    10: ("october", "oct", "oktober", "okt"),
    11: ("november", "nov"),
    12: ("december", "dec", "dezember", "dez"),
}
# Zone abbreviations that mean one offset, in minutes east of UTC.
_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "AEST": 600, "AEDT": 660,
}
_DAY_US = 86_400_000_000

_NAME = "(" + "|".join(n for names in _MONTHS.values() for n in sorted(names, key=len, reverse=True)) + r")\.?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m(?:\.|(?![a-z])))?(?:\s*uhr)?"
_ZONE = r"(?:\s*(?:utc|gmt)?\s*([+-]\d{2}(?::?\d{2})?))?(?:\s*[\[(]?\s*(z|[a-z]{2,5}|[a-z_]+(?:/[a-z_+-]+)+)\s*[\])]?)?"

#: The cascade, first match wins: an anchored pattern and the groups of year, month, day, then of hour, minute, second, fraction, a/p, offset, zone.
_CASCADE = {
    "iso": (r"^(\d{4})([-/])(\d{2})\2(\d{2})(?:(?:t|\s+)" + _TIME + ")?" + _ZONE + "$", (1, 3, 4), range(5, 12)),
    "basic": (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?()" + _ZONE + ")?$", (1, 2, 3), range(4, 11)),
    "ordinal": (r"^(\d{4})-(\d{3})()(?:(?:t|\s+)" + _TIME + ")?" + _ZONE + "$", (1, 3, 2), range(4, 11)),
    "digits": (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?:,?\s+" + _TIME + ")?" + _ZONE + "$", (4, 3, 1), range(5, 12)),
    "day_first": (r"^" + _WEEKDAY + r"(\d{1,2})(?:\.|st|nd|rd|th)?[\s-]+" + _NAME + r"[\s-]+(\d{4})(?:,?\s+(?:at\s+|um\s+)?" + _TIME + ")?" + _ZONE + "$", (3, 2, 1), range(4, 11)),
    "month_first": (r"^" + _WEEKDAY + _NAME + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,?\s+(?:at\s+)?" + _TIME + ")?" + _ZONE + "$", (3, 1, 2), range(4, 11)),
}
#: Plain numbers since 1970, by their digits before the point: seconds, milliseconds, microseconds, nanoseconds; with microseconds as a share of each.
_EPOCH = {r"^-?\d{9,11}(?:\.\d+)?$": (1_000_000, 1), r"^-?\d{12,14}(?:\.\d+)?$": (1_000, 1), r"^-?\d{15,17}(?:\.\d+)?$": (1, 1), r"^-?\d{18,20}(?:\.\d+)?$": (1, 1_000)}
#: What is taken for a local time that occurs twice, and for one that is skipped.
TWICE, SKIPPED = ("first", "second", "none"), ("before", "after", "none")


def _int(text: Column) -> Column:
    return F.when(text == "", None).otherwise(text).cast("int")


def _canonical(text: Column) -> Column:
    """The text's parts joined by ``|``: kind, year, month, day, hour, minute, second, fraction, a/p, offset, zone; null if no pattern fits."""
    out = None
    for kind, (pattern, date, rest) in _CASCADE.items():
        parts = F.regexp_replace(text, pattern, "|".join([kind, *(f"${i}" for i in (*date, *rest))]))
        out = F.when(text.rlike(pattern), parts) if out is None else out.when(text.rlike(pattern), parts)
    return out


def utc_micros(values: DataFrame, text: str = "value", tz: str = "tz", date_order: str = "date_order", out: str = "utc_us", twice: str = "first", skipped: str = "before") -> DataFrame:
    """Add the UTC instant, in microseconds since 1970, that each text of column ``text`` states.

    Method: an ordered cascade of anchored patterns read strictly (first match wins, no leftovers). A text that no
    pattern matches whole, that lacks year, month or day, or that states an impossible date or time gives null, as do
    null and empty texts; a text is read whole, however long. An offset in the text goes first, then a zone it names; else ``tz`` of the row, the
    zone of its source. ``date_order`` (``dmy``, ``mdy``; null is ``dmy``) rules digits with two-digit leading parts.
    Two-digit years are 20xx, no time of day is local midnight, plain numbers count from 1970 UTC (of nine digits or more:
    shorter ones are version numbers rather than times), digits beyond microseconds are cut.

    Policies: a local time that occurs ``twice`` means the ``first``, the ``second`` or ``none`` of its instants, unless offset
    or abbreviation tell; one that is ``skipped`` is read with the offset ``before`` or ``after`` the change or gives ``none``.
    All of it is column expressions, so nothing leaves the JVM.
    """
    if twice not in TWICE or skipped not in SKIPPED:
        raise ValueError(f"twice is one of {TWICE}, skipped one of {SKIPPED}")
    blank = r"[\s   　]+"
    raw = F.regexp_replace(F.regexp_replace(F.col(text), "[−‐‑‒–]", "-"), blank, " ")
    clean = F.lower(F.regexp_replace(raw, "^[\"'`“”‘’ ]+|[\"'`“”‘’ ]+$", ""))
    df = values.withColumn("__t", clean)
    epoch = None
    number = F.regexp_replace("__t", r"(\.\d{12})\d+$", "$1").cast("decimal(38,12)")
    for pattern, (times, share) in _EPOCH.items():
        hit = F.col("__t").rlike(pattern)
        got = F.floor(number * times / share).cast("bigint")
        epoch = F.when(hit, got) if epoch is None else epoch.when(hit, got)
    df = df.withColumn("__c", F.split(_canonical(F.col("__t")), r"\|")).withColumn("__epoch", epoch)
    names = F.create_map(*[F.lit(x) for n, spelt in _MONTHS.items() for name in spelt for x in (name, n)])
    c = lambda i: F.col("__c")[i]
    df = df.withColumns(
        {
            "__kind": c(0), "__y": _int(c(1)), "__m": F.when(c(2).rlike("^[0-9]*$"), _int(F.when(c(2).rlike("^[0-9]*$"), c(2)))).otherwise(F.try_element_at(names, c(2))),
            "__d": _int(c(3)), "__h": _int(c(4)), "__mi": _int(c(5)), "__s": F.coalesce(_int(c(6)), F.lit(0)),
            "__f": F.rpad(F.substring(c(7), 1, 6), 6, "0").cast("bigint"), "__half": c(8), "__offset": c(9), "__zone": c(10),
        }
    )
    p = lambda c: F.col(f"__{c}")
    order = F.coalesce(F.lower(F.trim(date_order)), F.lit("dmy"))
    swapped = (p("kind") == "digits") & (order == "mdy")
    year = F.when((p("kind") == "digits") & (p("y") < 100), p("y") + 2000).otherwise(p("y"))
    month = F.when(swapped, p("d")).otherwise(p("m"))
    day = F.when(swapped, p("m")).otherwise(p("d"))
    hour = F.when(p("half") == "", p("h")).when(p("h").between(1, 12), p("h") % 12 + F.when(p("half") == "p", 12).otherwise(0)).otherwise(99)
    df = df.withColumns({"__year": year, "__month": month, "__day": day, "__hour": hour})
    year, month, day = p("year"), p("month"), p("day")
    first = F.when((year >= 1) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    first_of_year = F.when(year >= 1, F.make_date(year, F.lit(1), F.lit(1)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(
        p("kind") == "ordinal",
        F.when((p("d") >= 1) & (p("d") <= F.when(leap, 366).otherwise(365)), F.unix_date(first_of_year) + p("d") - 1),
    ).otherwise(F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.unix_date(first) + day - 1))
    df = df.withColumn("__days", days)
    of_day = (
        F.when(p("h").isNull(), F.lit(0))
        .when((p("hour") <= 23) & (p("mi") <= 59) & (p("s") <= 59),
              (p("hour").cast("bigint") * 3600 + p("mi") * 60 + p("s")) * 1_000_000 + p("f"))
    )
    df = df.withColumn("__local", p("days").cast("bigint") * _DAY_US + of_day)

    df = df.withColumn("__digits", F.regexp_replace(p("offset"), "[^0-9]", ""))
    digits = p("digits")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    offset = F.when(p("offset") != "", F.when(p("offset").startswith("-"), -minutes).otherwise(minutes))
    short = F.create_map(*[F.lit(x) for k, v in _ABBREVIATIONS.items() for x in (k.lower(), v)])
    regions = {z.lower(): z for z in sorted(zoneinfo.available_timezones()) if "/" in z}
    by_text = F.when(p("zone").contains("/"), F.try_element_at(F.create_map(*[F.lit(x) for kv in regions.items() for x in kv]), p("zone")))
    abbreviated = F.when((p("zone") != "") & ~p("zone").contains("/"), F.try_element_at(short, p("zone")))
    fixed = F.coalesce(offset, abbreviated)
    own = F.when(F.col(tz).isin(*zoneinfo.available_timezones()), F.col(tz))
    zone = F.when(p("zone") != "", by_text).otherwise(own)
    df = df.withColumns({"__fixed": fixed, "__named": zone})
    fixed, zone = p("fixed"), p("named")
    utc = F.when(fixed.isNotNull(), F.col("__local") - fixed.cast("bigint") * 60_000_000).when(
        zone.isNotNull(), _zoned(F.col("__local"), zone, twice, skipped)
    )
    return df.withColumn(out, F.coalesce(utc, F.col("__epoch"))).select(*values.columns, out)


def _zoned(local: Column, zone: Column, twice: str, skipped: str) -> Column:
    """The instant (microseconds) of a local time in a zone, by the policies of :func:`utc_micros`."""
    there = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))
    # Spark takes the first of two instants, and the offset before a gap.
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))
    if (twice, skipped) == ("first", "before"):
        return first
    late = first + F.lit(_DAY_US)
    other = local - (there(late) - late)
    known = there(first) == local
    second = known & (other > first) & (there(other) == local)
    out = F.when(~known, {"before": first, "after": other, "none": F.lit(None).cast("bigint")}[skipped])
    return out.when(second, {"first": first, "second": other, "none": F.lit(None).cast("bigint")}[twice]).otherwise(first)


def registry_instants(registry: DataFrame, sites: DataFrame) -> DataFrame:
    """``reg_id, field, utc_us`` of every time that a document registration states.

    ``lastmodified`` counts for every kind, ``version`` only for tickets and pull threads. A registration delivered twice
    counts once (of differing rows the smallest); a source that is not listed has no zone of its own.
    """
    row = F.struct("source_id", "kind", "lastmodified", "version")
    once = registry.where(F.col("reg_id").isNotNull()).groupBy("reg_id").agg(F.min(row).alias("r")).select("reg_id", "r.*")
    zones = sites.groupBy(F.col("id").alias("site")).agg(F.min(F.struct("tz", "date_order")).alias("z")).select("site", "z.*")
    version = F.when(F.col("kind").isin("ticket", "pull"), F.col("version"))
    fields = F.array(
        F.struct(F.lit("lastmodified").alias("field"), F.col("lastmodified").alias("value")),
        F.struct(F.lit("version").alias("field"), version.alias("value")),
    )
    values = once.select("reg_id", "source_id", F.inline(fields)).where("value is not null")
    read = utc_micros(values.join(zones, values["source_id"] == zones["site"], "left"))
    # An exploded array of none or one drops the nulls; a filter would be pushed down and repeat the whole cascade in itself.
    return read.select("reg_id", "field", F.explode(F.array_compact(F.array("utc_us"))).alias("utc_us"))
