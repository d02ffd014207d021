"""Normalisers of text, values, units and times as column expressions. Nulls in give nulls out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The provenance tiers, strongest first, with their ranks.
TIER_RANK = {"executed": 3, "code": 2, "documented": 1}
CONNECTOR_TIERS = ("executed", "code")
# Unit spellings and the unit each stands for.
UNITS = {
    "usd": "usd", "$": "usd", "dollar": "usd", "dollars": "usd", "minute": "minute", "minutes": "minute", "min": "minute",
    "day": "day", "days": "day", "hour": "hour", "hours": "hour", "second": "second", "seconds": "second",
    "percent": "percent", "%": "percent", "count": "count", "times": "count", "clock": "clock",
}
# The source system of each document kind.
SOURCES = {"wiki": "wiki", "doc": "docs", "ticket": "tickets", "pull": "pulls", "code": "repo", "run": "runs"}
# Words that carry no search meaning.
STOPWORDS = (
    "a an and are as at be by does do for from how in is it its of on or that the this to what when where which who whom why with"
    " without within than then there their any not can"
).split()


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def tier_rank(tier: Column | str) -> Column:
    """3 executed, 2 code, 1 documented, 0 else."""
    return F.coalesce(_lookup(TIER_RANK, F.col(tier) if isinstance(tier, str) else tier), F.lit(0))


def later(a: Column, b: Column) -> Column:
    """a > b where a missing instant is the beginning of time; never null."""
    return a.isNotNull() & F.coalesce(a > b, F.lit(True))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two half-open periods meet; a missing start is the beginning of time, a missing end is open."""
    return (b_to.isNull() | later(b_to, a_from)) & (a_to.isNull() | later(a_to, b_from))


def statement(text: Column) -> Column:
    """Lower case, single blanks, no blanks or full stops at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), r"[ .]+$", "")


def attribute(text: Column) -> Column:
    """Letters and digits joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unit(text: Column) -> Column:
    """The unit that a spelling stands for; unknown ones pass in lower case; '', none and null give null."""
    plain = F.lower(F.trim(text))
    return F.when(~plain.isin("", "none", "null"), F.coalesce(_lookup(UNITS, plain), plain))


# Fixed value: how a claim value states a number, with marks of money and percent.
_NUMERIC = r"^\$?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:%|usd)?$"


def value_number(text: Column) -> Column:
    """The number that a claim value states (money and percent marks and thousands commas aside), else null."""
    plain = F.regexp_replace(F.lower(F.trim(text)), ",", "")
    return F.when(plain.rlike(_NUMERIC), F.regexp_extract(plain, _NUMERIC, 1).cast("double"))


def value_text(text: Column) -> Column:
    """The comparable text of a claim value that states no number, else null."""
    plain = F.regexp_replace(F.lower(F.trim(text)), ",", "")
    return F.when(~plain.rlike(_NUMERIC), plain)


def number_text(number: Column) -> Column:
    """A number in plain decimal digits without trailing zeros, the same whatever engine prints it."""
    digits = number.cast("decimal(28,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")


def document_kind(id: Column) -> Column:
    return F.split_part(id, F.lit("/"), F.lit(1))


def source_of(id: Column) -> Column:
    return F.coalesce(_lookup(SOURCES, document_kind(id)), F.lit("other"))


def terms(text: Column) -> Column:
    """Search words in order: lower case, no stop words, plural s dropped from words of more than four letters."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9$%.]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))
    plural = lambda w: (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def fold(name: Column) -> Column:
    """A name without case, blanks, hyphens, underscores, dots and slashes."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-_./]+", "")


def split_camel(text: Column) -> Column:
    """A blank between a small letter or digit and a capital."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def entity_name(text: Column) -> Column:
    """A name without case and punctuation, in single blanks; hyphens and underscores stay, as they tell names apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_\s-]", ""), r"\s+", " "))


def without_kind(text: Column, kinds: list[str]) -> Column:
    """A name without a kind and a colon before it."""
    rest = F.trim(F.substring(text, F.locate(":", text) + 1, F.length(text)))
    return F.when(text.contains(":") & F.lower(F.trim(F.split_part(text, F.lit(":"), F.lit(1)))).isin(*kinds) & (rest != ""), rest).otherwise(text)


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, sorted as text; trailing zeros of decimals do not count."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    trimmed = F.transform(found, lambda n: F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n))
    return F.array_sort(F.array_distinct(trimmed))


def plain(text: Column) -> Column:
    """Similarity form: lower case, no punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def slug(text: Column) -> Column:
    """A heading's anchor."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_\s-]", ""), r"\s", "-")


def infer_kind(name: Column) -> Column:
    """A kind guessed from a name's shape, first match of the ordered rules."""
    # The shapes of names and the kind of each.
    t = F.trim(name)
    return (
        F.when(t.rlike(r"^(GET|POST|PUT|PATCH|DELETE)\s+/"), "endpoint")
        .when(t.rlike(r"^[a-z]+(\.[a-z_]+)+$"), "queue")
        .when(t.rlike(r"Client$| [Cc]lient$"), "integration")
        .when(t.rlike(r"^[a-z]+([A-Z][a-z0-9]*)+$"), "job")
        .when(t.rlike(r"^[a-z]+(_[a-z]+)+$"), "table")
        .otherwise("rule")
    )


def infer_unit(name: Column) -> Column:
    """The unit that an attribute's name suggests, else null."""
    n = F.lower(name)
    return (
        F.when(n.rlike("minutes?([^a-z]|$)"), "minute")
        .when(n.rlike("days?([^a-z]|$)"), "day")
        .when(n.rlike("hours?([^a-z]|$)"), "hour")
        .when(n.rlike("seconds?([^a-z]|$)"), "second")
        .when(n.rlike("fee|price|amount|rate|cost"), "usd")
        .when(n.rlike("count|max|limit|size|copies|attempts"), "count")
    )


def category(text: Column) -> Column:
    """technical-implementation where a status code, a publishing verb or a path shows, else business-logic."""
    t = F.lower(text)
    technical = t.rlike("(^|[^0-9])[1-5][0-9]{2}([^0-9]|$)") | t.rlike("(^|[^a-z])publish") | t.rlike("[a-z_]+/[a-z_]+")
    return F.when(technical, "technical-implementation").otherwise("business-logic")
