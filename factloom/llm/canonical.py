"""Freely typed names mapped to the entries of a reference list.

Distinct normalised values are looked up in an inverted index of character n-grams over the list's names and aliases,
scored by weighted cosine, and accepted above a threshold and a margin; a word-by-word alignment then checks that no word
remains that would change what is meant. Values without an entry are reported with an empty id.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.scratch import Scratch

# Words that decorate any name, and what people type where they have no value.
DECORATION = ("the", "a", "an", "this", "that", "our")
PLACEHOLDERS = ("none", "null", "nil", "na", "misc", "xxx", "tbd", "todo", "unknown", "n")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмнтвгопαοερτικνυχ", "aeopcyxijsdhkmhtbronaoeptiknux"[:30])


@dataclass(frozen=True)
class Vocabulary:
    """What values may hold besides a name: ``decoration`` never tells things apart, ``placeholders`` and texts that match ``code`` tell nothing.

    ``kinds`` are the words for the kinds of things, ``markers`` words that go with one kind; both are learned from the list (see :func:`learned`).
    """

    decoration: frozenset[str] = frozenset(DECORATION)
    placeholders: frozenset[str] = frozenset(PLACEHOLDERS)
    code: str = r"\s*[A-Za-z]{2,4}[-_ ]\d+\s*"
    kinds: dict[str, str] = field(default_factory=dict)
    markers: dict[str, str] = field(default_factory=dict)


_VOWELS = re.compile(r"(?<=.)[aeiou]")


def normal_words(text: str | None) -> list[str]:
    """Lower-case words of a name, whatever its width, accents, look-alike letters, quotes, camel case or spacing."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    text = unicodedata.normalize("NFD", text.lower())
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)
    spaced = re.fullmatch(r"\W*(?:[a-z0-9](?:[\s_./-]|$)+)+\W*", text)
    if spaced and len(text) > 5:
        parts = re.split(r"[\s_./-]{2,}", text.strip())
        return [w for w in ("".join(re.findall(r"[a-z0-9]", p)) for p in parts) if w]
    return re.findall(r"[a-z0-9]+", text)


def content_words(text: str | None, vocabulary: Vocabulary) -> list[str]:
    """The words of a name without decoration, version marks, kinds and what marks them; all its words if nothing else is left."""
    words = normal_words(text)
    skip = {*vocabulary.decoration, *vocabulary.kinds, *vocabulary.markers}
    return [w for w in words if w not in skip and not re.fullmatch(r"v\d+", w)] or [w for w in words if w not in vocabulary.decoration]


def tells_nothing(text: str | None, vocabulary: Vocabulary) -> bool:
    """Whether a name is empty, a placeholder, a bare number or a code."""
    if not text or re.fullmatch(vocabulary.code, text):
        return True
    skip = {*vocabulary.placeholders, *vocabulary.decoration, *vocabulary.kinds, *vocabulary.markers}
    return all(w in skip or w.isdigit() or len(w) == 1 for w in normal_words(text))


def skeleton(word: str) -> str:
    """The first letter and the consonants after it."""
    return _VOWELS.sub("", word)


def grams(words: list[str], n: int = 3) -> list[str]:
    """Character n-grams of the joined words, and of their consonants (marked), so that spelled-out and shortened forms meet."""
    out = []
    for mark, text in (("", "".join(words)), ("~", "".join(skeleton(w) for w in words))):
        out += [mark + text[i : i + n] for i in range(max(1, len(text) - n + 1))] if text else []
    return out


@lru_cache(200_000)
def distance(a: str, b: str) -> int:
    """Edits between two words; a swap of neighbours is one."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@lru_cache(400_000)
def word_cost(word: str, meant: str) -> float | None:
    """What it costs to read ``word`` as ``meant``: None if it cannot be."""
    if word == meant:
        return 0.0
    if word in (meant + "s", meant + "es"):
        return 0.1
    if len(word) >= 2 and word == skeleton(meant):
        return 0.2
    if len(word) >= 3 and meant.startswith(word):
        return 0.2 + 0.02 * (len(meant) - len(word))
    # An edit takes away one letter and brings in another at most.
    near = abs(len(word) - len(meant)) <= 2 and len({*word} ^ {*meant}) <= 4
    edits = distance(word, meant) if near else 9
    if edits <= (0 if min(len(word), len(meant)) < 4 else 1 if len(meant) < 6 else 2) and not _other_ending(word, meant, edits):
        return 0.3 * edits
    # A plural form with one slip.
    if word.endswith("s") and len(meant) >= 6 and near and distance(word[:-1], meant) <= 1:
        return 0.4
    return None


def _other_ending(word: str, meant: str, edits: int) -> bool:
    """Whether two edits give a long common start another ending of other letters: that is another word (register, registrar), not two slips."""
    if edits < 2:
        return False
    head = 0
    while head < min(len(word), len(meant)) and word[head] == meant[head]:
        head += 1
    a, b = Counter(word), Counter(meant)
    return head >= 4 and word[-2:] != meant[-2:] and sum(((a - b) + (b - a)).values()) >= 3


def segmented(joined: str, lexicon: frozenset[str] | set[str]) -> list[str] | None:
    """The words of the list that make up a string without a rest (the fewest), or None."""
    longest = max(map(len, lexicon), default=0)
    best: list[list[str] | None] = [[]] + [None] * len(joined)
    for end in range(1, len(joined) + 1):
        for start in range(max(0, end - longest), end):
            if best[start] is not None and joined[start:end] in lexicon and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = [*best[start], joined[start:end]]
    return best[-1]


def align(words: list[str], meant: list[str], lexicon: frozenset[str] | set[str], max_cost: float = 1.3) -> float | None:
    """Least cost of reading all ``words`` as all ``meant`` words in any order, or None if any word is left over or it is above ``max_cost``.

    ``lexicon`` has the words of the list that occur in the joined words: those mean just themselves. Names of any number of words
    are read: only words that can be read as one another are ever paired.
    """
    return _aligned_with(words, segmented("".join(words), lexicon), meant, lexicon, max_cost)


def _aligned_with(words: list[str], known: list[str] | None, meant: list[str], lexicon: frozenset[str] | set[str], max_cost: float) -> float | None:
    if known is not None:
        return (0.0 if known == meant else 0.05) if sorted(known) == sorted(meant) else None
    cost = lambda w, m: 0.0 if w == m else None if w in lexicon else word_cost(w, m)
    best = _matched(words, meant, cost, max_cost) if len(words) == len(meant) else None
    return best if best is not None else _joined("".join(words), meant, cost, max_cost)


def _matched(words: list[str], meant: list[str], cost, limit: float) -> float | None:
    """Least sum of costs of a one-to-one reading; 0.05 more where it is not in order. The words with the fewest readings are read first."""
    reads = [[(c, j) for j, m in enumerate(meant) if (c := cost(w, m)) is not None and c <= limit] for w in words]
    if not all(reads):
        return None
    straight = [next((c for c, j in r if j == i), None) for i, r in enumerate(reads)]
    best = sum(straight) if None not in straight else None
    order = sorted(range(len(words)), key=lambda i: len(reads[i]))
    rest = [0.0]
    for i in reversed(order):
        rest.append(rest[-1] + min(reads[i])[0])
    rest.reverse()
    found = [limit if best is None else min(limit, best)]
    hit = best is not None and best <= limit

    def read(at: int, taken: frozenset[int], total: float, turned: bool) -> None:
        nonlocal hit
        if total + rest[at] + 0.05 * turned > found[0]:
            return
        if at == len(order):
            found[0], hit = total + 0.05 * turned, True
            return
        for c, j in sorted(reads[order[at]]):
            if j not in taken:
                read(at + 1, taken | {j}, total + c, turned or j != order[at])

    read(0, frozenset(), 0.0, False)
    return found[0] if hit else None


def _joined(joined: str, meant: list[str], cost, limit: float) -> float | None:
    """Least cost of reading a string as the meant words written together or apart elsewhere, in any order."""
    if not meant or abs(len(joined) - sum(map(len, meant))) > 2 * len(meant) and len(meant) > 1:
        return None
    if len({*joined} ^ {c for m in meant for c in m}) > 4 * len(meant) and len(meant) > 1:  # more letters come or go than two edits a word bring about
        return None
    if len(meant) == 1:
        alone = cost(joined, meant[0])
        return None if alone is None or alone + 0.1 > limit else alone + 0.1

    @lru_cache(None)
    def read(at: int, left: tuple[int, ...]) -> tuple[float, bool] | None:
        if not left:
            return (0.0, False) if at == len(joined) else None
        best = None
        for n, j in enumerate(left):
            sizes = (len(joined) - at,) if len(left) == 1 else range(max(1, len(meant[j]) - 2), len(meant[j]) + 3)
            for size in sizes:
                if size < 1 or at + size > len(joined):
                    continue
                head = cost(joined[at : at + size], meant[j])
                if head is None or head > limit:
                    continue
                tail = read(at + size, left[:n] + left[n + 1 :])
                if tail is not None:
                    found = (head + tail[0], tail[1] or n > 0)
                    if best is None or found[0] + 0.05 * found[1] < best[0] + 0.05 * best[1]:
                        best = found
        return best

    found = read(0, tuple(range(len(meant))))
    if found is None:
        return None
    total = found[0] + 0.1 + 0.05 * found[1]
    return total if total <= limit else None


def map_to_list(
    entities: DataFrame,
    catalog: DataFrame,
    threshold: float = 0.3,
    margin: float = 0.02,
    max_cost: float = 1.3,
    catalog_bound: int = 100_000,
    vocabulary: Vocabulary = Vocabulary(),
) -> DataFrame:
    """``entity_id, catalog_id``: one row per id of ``entities`` (``id, name, kind, aliases``), '' where the list has no entry.

    The name decides; where it tells nothing (empty, a placeholder, a code, or a single word that the list's words do not
    contain) the aliases do, in their order. Several entries of one name are told apart by kind: that of the entity,
    else one that the value itself states, else the smallest id. Rows that repeat an id count once (the smallest row). Null
    names, aliases and kinds, nulls in aliases, empty values, values of any length that are no name and an empty list all give ''.

    Method: (1) distinct normalised values; those that equal a name of the list are that name; (2) for the others candidates by an
    inverted index of character 3-grams; (3) cosine of inverse-frequency weights, at least ``threshold``; (4) the best candidate whose
    words all align (edit distance, abbreviations, plurals, any order) within ``max_cost`` must lead by ``margin`` in cosine, or
    clearly in cost. What states a kind is learned from the list, what else decorates a value is a parameter (``vocabulary``).
    The list is broadcast only if it has at most ``catalog_bound`` names; else every join with it shuffles, with the same result.
    Nothing of the index is collected: a gram of many names is that many rows.
    """
    spark = entities.sparkSession
    scratch = Scratch(spark, "canonical")
    row = F.struct("name", "kind", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    names = catalog.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("kind", "name", "aliases")).alias("r")).select("id", "r.*")
    names = names.select("id", "kind", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "value"))
    names = scratch.save(names.where("value IS NOT NULL"), "names")
    vocabulary = learned(names, vocabulary)
    once = entities.where("id IS NOT NULL").groupBy("id").agg(F.min(row).alias("r")).select("id", "r.*")
    values = once.select("id", "kind", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "value")).where("value IS NOT NULL")
    values = scratch.save(_described(values, vocabulary), "values")

    keys = scratch.save(_described(names, vocabulary).where("key <> ''"), "keys")
    small = keys.count() <= catalog_bound
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    listed = keys.groupBy(F.col("key").alias("cand")).agg(F.array_sort(F.collect_set(F.struct("id", "kind"))).alias("entries"))
    listed = scratch.save(listed.withColumn("c", F.monotonically_increasing_id()), "listed")
    total = listed.count()
    distinct = values.where("key <> ''").select("key").distinct()
    same = distinct.join(near(listed.select(F.col("cand").alias("key"), F.lit(True).alias("same"))), "key", "left")
    asked = scratch.save(same.withColumn("k", F.monotonically_increasing_id()), "asked")

    found = _retrieved(asked.where("same IS NULL").select("k", "key"), listed.select("c", "cand"), total, threshold, near)
    words = listed.select(F.explode(F.split("cand", " ")).alias("word")).distinct()
    pairs = found.join(near(listed.select("c", "cand")), "c").join(_spoken(asked.where("same IS NULL"), words, small), "k")
    fits = scratch.save(_aligned(pairs.select("k", "key", "spoken", "c", "cand", "cos"), max_cost), "fits")
    best = F.row_number().over(W.partitionBy("k").orderBy("cost", F.desc("cos"), "cand"))
    lead = W.partitionBy("k").orderBy("n")
    top = fits.withColumn("n", best).withColumn("cost2", F.lead("cost").over(lead)).withColumn("cos2", F.lead("cos").over(lead)).where("n = 1")
    sure = top.where(F.col("cost2").isNull() | (F.col("cost2") - F.col("cost") > 0.04) | (F.col("cos") - F.col("cos2") >= margin))
    chosen = sure.select("key", "cand").unionByName(asked.where("same").select("key", F.col("key").alias("cand")))
    matched = values.join(chosen.join(near(listed.select("cand", "entries")), "cand").select("key", "entries"), "key", "left")
    # A placeholder that is a name of the list is that name; nothing like one is.
    matched = matched.join(asked.where("same").select("key", "same"), "key", "left").withColumn("blank", F.col("blank") & F.col("same").isNull())
    matched = matched.withColumn("entries", F.when(~F.col("blank"), F.col("entries")))

    own = F.filter("entries", lambda e: e["kind"] == F.col("kind"))
    said = F.filter("entries", lambda e: e["kind"] == F.col("stated"))
    pick = (
        F.when(F.size("entries") == 1, F.col("entries")[0]["id"])
        .when(F.size(own) == 1, own[0]["id"])
        .when(F.size(said) == 1, said[0]["id"])
        .otherwise(F.col("entries")[0]["id"])
    )
    rated = matched.withColumn("pick", pick).withColumn("told", ~F.col("blank") & (F.col("entries").isNotNull() | F.col("telling")))
    name = F.max(F.when(F.col("pos") == 0, F.struct(F.col("told"), F.col("pick"))))
    alias = F.min(F.when((F.col("pos") > 0) & F.col("pick").isNotNull(), F.struct("pos", "pick")))
    decided = rated.groupBy("id").agg(name.alias("name"), alias.alias("alias"))
    chosen = F.when(F.col("name.told"), F.coalesce("name.pick", F.lit(""))).otherwise(F.coalesce("alias.pick", F.lit("")))
    return once.select("id").join(decided, "id", "left").select(F.col("id").alias("entity_id"), F.coalesce(chosen, F.lit("")).alias("catalog_id"))


def learned(names: DataFrame, vocabulary: Vocabulary, share: float = 0.1, least: int = 20) -> Vocabulary:
    """The vocabulary with the words for kinds that the list (``id, kind, pos, value``) uses, and those that mark them.

    A kind of one word states itself; a word that begins names of one kind only, at least ``share`` of the names of that kind (which has
    ``least`` names or more), and stands nowhere else marks it. Of a list without kinds nothing is learned. At most 1 / ``share`` words
    a kind reach the driver.
    """
    first = names.where("pos = 0 AND kind IS NOT NULL")
    kinds = first.groupBy("kind").agg(F.count("*").alias("names"))
    split = F.filter(F.split(F.lower("value"), "[^a-z0-9]+"), lambda w: w != "")
    words = first.select("kind", F.posexplode(split).alias("at", "word")).groupBy("word", "kind").agg(F.count_if(F.col("at") == 0).alias("begins"), F.count("*").alias("n"))
    sole = words.groupBy("word").agg(F.count("*").alias("k"), F.max("kind").alias("kind"), F.sum("n").alias("n"), F.sum("begins").alias("begins")).where("k = 1 AND begins = n")
    marks = sole.join(kinds, "kind").where((F.col("n") >= share * F.col("names")) & (F.col("names") >= least)).select("word", "kind").collect()
    plain = kinds.where(F.col("kind").rlike("^[A-Za-z]+$")).select(F.lower("kind").alias("word"), "kind").where(F.col("names") >= 1).limit(1_000).collect() if marks or not kinds.isEmpty() else []
    return Vocabulary(
        vocabulary.decoration, vocabulary.placeholders, vocabulary.code,
        vocabulary.kinds | {r["word"]: r["kind"] for r in plain}, vocabulary.markers | {r["word"]: r["kind"] for r in marks},
    )


def _described(values: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Add to every value its key (content words in order), whether it is blank or telling, and the kind it states."""
    stating = vocabulary.markers | vocabulary.kinds
    paths = set(vocabulary.markers.values())
    path = next(iter(paths)) if len(paths) == 1 else None

    def state(words: list[str], value: str) -> str | None:
        return next((vocabulary.kinds[w] for w in words if w in vocabulary.kinds), None) or next((stating[w] for w in words if w in stating), path if "/" in value else None)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [content_words(v, vocabulary) for v in frame["value"]]
            blank = [tells_nothing(v, vocabulary) for v in frame["value"]]
            stated = [state(normal_words(v), v) for v in frame["value"]]
            yield frame[["id", "kind", "pos"]].assign(key=[" ".join(c) for c in content], blank=blank, telling=[len(c) > 1 for c in content], stated=stated)

    return values.select("id", "kind", "pos", "value").mapInPandas(work, "id string, kind string, pos int, key string, blank boolean, telling boolean, stated string")


def _counted(key):
    """The distinct grams of a key with their counts."""

    @F.pandas_udf("array<struct<gram:string,count:int>>")
    def split(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: [{"gram": g, "count": n} for g, n in Counter(grams(k.split(" "))).items()])

    return split(key)


def _retrieved(asked: DataFrame, listed: DataFrame, total: int, threshold: float, near) -> DataFrame:
    """``k, c, cos``: the names of the list (``c, cand``) whose gram vectors have a cosine of ``threshold`` or more with a value's (``k, key``)."""
    tf = listed.select("c", F.inline(_counted(F.col("cand"))))
    df = tf.groupBy("gram").agg(F.count("*").alias("df")).select("gram", F.log(F.lit(total + 1.0) / F.col("df")).alias("w"))
    weighted = tf.join(df, "gram").withColumn("x", F.col("count") * F.col("w"))
    norms = weighted.groupBy("c").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    posts = weighted.join(norms, "c").select("gram", "c", (F.col("x") * F.col("w") / F.col("norm")).cast("float").alias("share"))
    # Grams stay with their value, so with a broadcast list the products are summed where they arise.
    mine = asked.select("k", _counted(F.col("key")).alias("grams")).repartition("k").select("k", F.inline("grams"))
    rare = math.log(total + 1.0)
    lengths = mine.join(near(df), "gram", "left").groupBy("k").agg(F.sqrt(F.sum(F.pow(F.col("count") * F.coalesce("w", F.lit(rare)), 2))).alias("length"))
    dots = mine.join(near(posts), "gram").groupBy("k", "c").agg(F.sum(F.col("count") * F.col("share")).alias("dot"))
    return dots.join(lengths, "k").select("k", "c", (F.col("dot") / F.col("length")).alias("cos")).where(F.col("cos") >= threshold)


def _spoken(asked: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """``k, key, spoken``: every value with the words of the list that occur in its joined words."""
    if small:
        lexicon = asked.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words.collect()))  # at most the words of catalog_bound names

        @F.pandas_udf("array<string>")
        def within(keys: pd.Series) -> pd.Series:
            known, longest = lexicon.value, max(map(len, lexicon.value), default=0)
            return keys.map(lambda k: sorted({j[a:b] for j in [k.replace(" ", "")] for a in range(len(j)) for b in range(a + 1, min(len(j), a + longest) + 1)} & known))

        return asked.select("k", "key", within("key").alias("spoken"))
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("n")).first()["n"]
    joined = asked.select("k", F.regexp_replace("key", " ", "").alias("j"))
    parts = joined.select("k", "j", F.explode(F.sequence(F.lit(1), F.length("j"))).alias("at"))
    parts = parts.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(longest), F.length("j") - F.col("at") + 1))), lambda n: F.substring(F.col("j"), F.col("at"), n))).alias("word"))
    heard = parts.distinct().join(words, "word").groupBy("k").agg(F.array_sort(F.collect_set("word")).alias("spoken"))
    return asked.select("k", "key").join(heard, "k", "left").withColumn("spoken", F.coalesce("spoken", F.array().cast("array<string>")))


def _aligned(pairs: DataFrame, max_cost: float) -> DataFrame:
    """The pairs of value and list key whose words align, with the cost."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values: dict[str, tuple] = {}
        for frame in frames:
            costs = []
            for key, cand, spoken in zip(frame["key"], frame["cand"], frame["spoken"]):
                if key not in values:
                    if len(values) > 50_000:
                        values.clear()
                    lexicon = frozenset(spoken)
                    values[key] = key.split(" "), segmented(key.replace(" ", ""), lexicon), lexicon
                words, known, lexicon = values[key]
                costs.append(_aligned_with(words, known, cand.split(" "), lexicon, max_cost))
            frame = frame.assign(cost=pd.Series(costs, dtype="float64", index=frame.index))
            yield frame.loc[frame["cost"].notna(), ["k", "key", "c", "cand", "cos", "cost"]]

    return pairs.mapInPandas(work, "k bigint, key string, c bigint, cand string, cos double, cost double")
