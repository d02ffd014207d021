"""Matching of statements and claims: native vetoes first, a greedy one-to-one assignment last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.scratch import Scratch

_NEGATION = r"(^|[^a-z])(not|never|no|none|without|off|cannot|can't|isn't|doesn't|no longer)([^a-z]|$)"
# Words that set a bound of time, inside or beyond it, and the units of time.
INSIDE = ("within", "less than", "under", "up to", "at most")
BEYOND = ("past", "after", "more than", "beyond", "longer than")
TIMES = ("second", "minute", "hour", "day", "week", "month", "year")
#: "the past 7 days" is a window and no bound.
_WINDOW = r"(^|[^a-z0-9_])the\s+(" + "|".join((*INSIDE, *BEYOND)) + r")\s"
_BOUND = r"(^|[^a-z0-9_])(" + "|".join((*INSIDE, *BEYOND)) + r")\s+([0-9]+(?:\.[0-9]+)?)\s+(" + "|".join(TIMES) + r")s?([^a-z0-9_]|$)"


def negated(text: Column) -> Column:
    """Whether a statement denies something."""
    return F.lower(text).rlike(_NEGATION)


def allowed(text: Column) -> Column:
    """'refused', 'allowed' or null, by the words a statement uses for an outcome; refusal is looked for first."""
    t = F.lower(text)
    return F.when(t.rlike("reject|refus|den(y|ied)|must not|fails?([^a-z]|$)"), "refused").when(t.rlike("accept|allow|grant|succeed|still returns"), "allowed")


def bounds(text: Column) -> Column:
    """All bounds of time that a text sets, as 'inside n unit' or 'beyond n unit', each once and sorted; none gives an empty array."""
    t = F.regexp_replace(F.lower(text), _WINDOW, "$1")
    part = lambda n: F.regexp_extract_all(t, F.lit(_BOUND), F.lit(n))
    side = lambda w: F.when(w.isin(*INSIDE), "inside").otherwise("beyond")
    number = lambda n: F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n)
    found = F.transform(F.arrays_zip(part(2).alias("w"), part(3).alias("n"), part(4).alias("u")), lambda x: F.concat_ws(" ", side(x["w"]), number(x["n"]), x["u"]))
    return F.array_sort(F.array_distinct(found))


def bounds_conflict(a: Column, b: Column) -> Column:
    """Whether two texts bound the same number of one unit and not on the same sides."""
    x, y = bounds(a), bounds(b)
    key = lambda e: F.regexp_replace(e, "^(inside|beyond) ", "")
    odd = F.array_union(F.array_except(x, y), F.array_except(y, x))
    both = F.array_intersect(F.transform(x, key), F.transform(y, key))
    return F.exists(odd, lambda e: F.array_contains(both, key(e)))


# How texts name status codes, classes of them and places in an order, none of which is a quantity; and the shapes of numbers, the first that fits.
HTTP_CODE = r"(http|status)( code)? [1-5][0-9][0-9]"
CODE_CLASS = r"[1-5]xx"
ORDINAL = r"[0-9]+(st|nd|rd|th)"
NUMBER = r"\$[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?%|[0-9]{1,2}:[0-9]{2}|[0-9][0-9,]*(?:\.[0-9]+)?"


def number_tokens(text: Column) -> Column:
    """The numbers of a text in order, with the mark of their kind; thousands commas and zeros after the point do not count."""
    t = F.lower(text)
    for pattern in (HTTP_CODE, CODE_CLASS, ORDINAL):
        t = F.regexp_replace(t, pattern, " ")
    bare = lambda x: F.regexp_replace(x, ",", "")
    cut = lambda x: F.regexp_replace(F.regexp_replace(x, "0+(%?)$", "$1"), r"\.(%?)$", "$1")
    return F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: F.when(x.contains(".") & ~x.contains(":"), cut(bare(x))).otherwise(bare(x)))


def number_kind(token: Column) -> Column:
    """money, percent, time or plain."""
    return F.when(token.startswith("$"), "money").when(token.endswith("%"), "percent").when(token.contains(":"), "time").otherwise("plain")


def words(text: Column) -> Column:
    """The words of a text in order, hyphens and underscores apart, without punctuation and the s of a plural."""
    plain = norm.plain(F.regexp_replace(text, "[-_]+", " "))
    kept = F.filter(F.split(plain, " "), lambda w: w != "")
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(kept, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the shorter list, a word as often as both have it; 0 where a list is empty."""
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.round(shared / least, 6)).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct terms over the smaller number of them; 0 where one side has none."""
    x, y = F.array_distinct(norm.terms(a)), F.array_distinct(norm.terms(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.round(F.size(F.array_intersect(x, y)) / least, 6)).otherwise(F.lit(0.0))


def numbers_compatible(truth: Column, found: Column) -> Column:
    """Every number of the truth occurs in what was found; without any in the truth there must be none."""
    t, f = norm.numbers(truth), norm.numbers(found)
    return F.when(F.size(t) == 0, F.size(f) == 0).otherwise(F.size(F.array_except(t, f)) == 0)


def statements_match(truth: Column, found: Column, least: float = 0.6) -> Column:
    """The veto chain (negation, outcome, bound, numbers), then term overlap of at least ``least``."""
    differs = lambda f: f(truth).isNotNull() & f(found).isNotNull() & (f(truth) != f(found))
    veto = (negated(truth) != negated(found)) | differs(allowed) | bounds_conflict(truth, found) | ~numbers_compatible(truth, found)
    return ~veto & (overlap_coefficient(truth, found) >= least)


def assign(returned: DataFrame, expected: DataFrame, pairs: DataFrame, together: int = 5) -> DataFrame:
    """One-to-one assignment within each group: in the order of ``ordinal`` every returned item takes its best free expected one: ``grp, returned, expected``.

    ``returned`` has ``grp, returned, side, ordinal``, ``expected`` has ``grp, expected, side``; ``side`` names a class of like items. ``pairs``
    has ``grp, a, b, score``: which class of returned items (a) may take which of expected ones (b), the highest score first, then the smaller b;
    in a class the smaller id goes first. Rows that repeat an item are taken as they come, so items must be unique; nulls take no part.

    Method: every item asks its best class that has not refused it; a class keeps as many as it has items, the first in order, and refuses the
    others, who ask on. As all classes prefer the same order, what is kept in the end is what taking turns gives. No group is a task, and there is
    no limit on items. ``together`` rounds are one plan, written to the shared folder; groups in which nobody is refused any more are done.
    """
    scratch = Scratch(returned.sparkSession, "assign")
    rank = F.row_number().over(W.partitionBy("grp", "a").orderBy(F.desc("score"), "b"))
    wishes = scratch.save(pairs.select("grp", "a", "b", rank.alias("wish")), "wishes")
    room = scratch.save(expected.groupBy("grp", F.col("side").alias("b")).agg(F.count("*").alias("room")), "room")
    order = W.partitionBy("grp", "b").orderBy("ordinal", "returned")
    step = returned.select("grp", "returned", F.col("side").alias("a"), "ordinal", F.lit(1).alias("wish"))
    done = []
    while True:
        for _ in range(together):
            asked = step.select("grp", "returned", "a", "ordinal", "wish").join(wishes, ["grp", "a", "wish"]).join(room, ["grp", "b"]).withColumn("place", F.row_number().over(order))
            refused = F.col("place") > F.col("room")
            step = asked.select("grp", "returned", "a", "b", "ordinal", (F.col("wish") + refused.cast("int")).alias("wish"), "place", refused.alias("refused"))
        step = scratch.save(step, "rounds")
        open_ = scratch.save(step.where("refused").select("grp").distinct(), "open")
        done.append(scratch.save(step.join(open_, "grp", "left_anti"), "done"))
        if open_.isEmpty():
            break
        step = step.join(open_, "grp", "left_semi")
    step = scratch.together(done)
    own = F.row_number().over(W.partitionBy("grp", "side").orderBy("expected"))
    seats = expected.select("grp", F.col("side").alias("b"), "expected", own.alias("place"))
    return step.join(seats, ["grp", "b", "place"]).select("grp", "returned", "expected")


def term_pairs(classes: DataFrame, key: list[str], least: float, split: int = 16) -> DataFrame:
    """Pairs ``a < b`` of classes (``name, text`` and the columns of ``key``) of one key whose term sets overlap by ``least`` or more, with ``overlap``.

    Candidates meet in an inverted index of terms. A class looks for others by its rarest terms only: of n terms all but ``least`` n are enough, as who shares
    none of these shares too few. Where a term of a key is common, those that look for it are spread over ``split`` parts.
    """
    terms = classes.select(*key, "name", F.array_distinct(norm.terms(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    flat = terms.select(*key, "name", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    df = flat.groupBy(*key, "term").agg(F.count("*").alias("df"))
    rarity = W.partitionBy(*key, "name").orderBy("df", "term")
    ranked = flat.join(df, [*key, "term"]).withColumn("r", F.row_number().over(rarity))
    salt = F.when(F.col("df") > 1_000, F.pmod(F.xxhash64("name"), F.lit(split)).cast("int")).otherwise(F.lit(0))
    probe = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(*key, "term", salt.alias("salt"), F.col("name").alias("p"), F.col("n").alias("n_p"))
    parts = F.when(F.col("df") > 1_000, F.sequence(F.lit(0), F.lit(split - 1))).otherwise(F.array(F.lit(0)))
    stock = ranked.select(*key, "term", F.explode(parts).alias("salt"), F.col("name").alias("q"), F.col("n").alias("n_q"))
    # The smaller set decides, so it is the one that looks.
    met = probe.join(stock, [*key, "term", "salt"]).where("p <> q AND (n_p < n_q OR (n_p = n_q AND p < q))").select(*key, "p", "q").distinct()
    side = lambda c: terms.select(*key, F.col("name").alias(c), F.col("terms").alias(f"t_{c}"))
    wide = met.join(side("p"), [*key, "p"]).join(side("q"), [*key, "q"])
    overlap = F.round(F.size(F.array_intersect("t_p", "t_q")) / F.least(F.size("t_p"), F.size("t_q")), 6)
    return wide.select(*key, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), overlap.alias("overlap")).where(F.col("overlap") >= least)


def statement_classes(facts: DataFrame, key: list[str]) -> DataFrame:
    """``key, name, text, n``: the facts (``id, statement`` and the key) of one statement, whatever its case and spacing, named by the smallest id."""
    rows = reduce(lambda df, c: df.where(F.col(c).isNotNull()), ["statement", *key], facts)
    said = norm.statement(F.col("statement"))
    return rows.groupBy(*key, said.alias("text")).agg(F.min("id").alias("name"), F.count("*").alias("n")).where("text <> ''")
