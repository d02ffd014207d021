"""Passages of held-out texts inside a corpus: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch
from factloom.session import spread

# Characters that a scan, another script or a digit key confuses, each with the one that stands for its class.
_CLASSES = str.maketrans("01|!ijtf5$8e60qgñаеорсухіјѕԁкмнтв", "oollllllssbccogonaeopcyxllsdkmhlb"[:33])
_SAME = str.maketrans({"e": "c", "o": "c", "0": "c", "q": "g"})
_ONE = _SAME | {key: _SAME.get(value, value) for key, value in _CLASSES.items()}
_BROKEN = re.compile(r"\\|%[0-9A-Fa-f]{2}|[-­]\s*\n")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrtbf\"'\\/])|%([0-9A-Fa-f]{2})(?=%|\w|\b)|(\w)(?:-|­)\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def _plain(match: re.Match) -> str:
    code, short, _, broken = match.groups()
    if code:
        return chr(int(code, 16))
    if broken:
        return broken
    return " " if short else match.group(0)


def canonical_words(text: str) -> list[str]:
    """The words of a text without case, marks, accents, markup and escapes; letters that are easily confused become one."""
    if "&" in text:
        text = html.unescape(text)
    if _BROKEN.search(text):
        text = _ESCAPE.sub(_plain, _ESCAPE.sub(_plain, text))
    text = unicodedata.normalize("NFKD", text.lower())
    if not text.isascii():
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _WORD.findall(text.translate(_ONE))


def fingerprints(texts: list[list[str]], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing over the joined letters of the words of every text: number of the text, positions and hashes of the least k-gram of every ``window`` neighbouring ones.

    All texts are hashed at once, one after the other with a mark between; of equal hashes the last counts. A text of fewer k-grams has one window.
    """
    joined = ["".join(words) for words in texts]
    codes = np.frombuffer(("\n".join(joined) + "\n").encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    n = len(codes) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    hashed, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        whole &= codes[j : j + n] != 10
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    # What is no k-gram of one text never is the least; k - 1 of them and the mark lie between two texts.
    hashed = np.append(np.where(whole, hashed, ~np.uint64(0)), np.full(window, ~np.uint64(0)))
    least, at = hashed[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = hashed[j : j + n] <= least
        less &= np.append(whole, np.zeros(window, bool))[j : j + n]
        least, at = np.where(less, hashed[j : j + n], least), np.where(less, np.arange(j, n + j), at)
    last = np.append(whole, np.zeros(window, bool))[window - 1 : window - 1 + n]
    first = whole & ~np.append(False, whole[:-1])
    at = np.unique(at[whole & (last | first)])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in joined])])
    text = np.searchsorted(starts, at, side="right") - 1
    return text, (at - starts[text]).astype(np.int32), hashed[at].view(np.int64)


@lru_cache(100_000)
def same_word(a: str, b: str) -> bool:
    """Whether two canonical words are one word, but for a slip of one letter in a longer word."""
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _one_less(word: str) -> list[str]:
    """A word of five or more letters and what is left of it without any one of them; two words that differ by a slip share one of these."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= 4 and not word.isdigit() else [word]


class Wanted:
    """The words of an item, looked up by what a text has for them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = sum(map(len, words))
        self.places: dict[str, list[int]] = {}
        for n, word in enumerate(words, 1):
            self.places.setdefault(word, []).append(n)
        self.near: dict[str, set[str]] = {}
        for word in self.places:
            for part in _one_less(word):
                self.near.setdefault(part, set()).add(word)
        self.known: dict[str, list[int]] = {}

    def at(self, word: str) -> list[int]:
        """The places of the item's words that the word is, but for a slip."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            close = {w for part in _one_less(word) for w in self.near.get(part, ()) if same_word(word, w)}
            found = self.known[word] = sorted(n for w in close for n in self.places[w])
        return found


def longest_stretch(item: Wanted, doc: list[str], drop: int = 2, least: int = 8) -> int:
    """Words of the item from first to last in the longest stretch that the document carries.

    Words are aligned in order; a word may be changed, lost or added, each costs what a match gains, and a path that falls
    more than ``drop`` below its best is given up, so single words may differ but not passages. Only stretches count
    that have ``least`` more matches than changes; sentences of one pattern with other nouns do not reach that. Only matches are
    visited: a path goes from one to another at most ``drop`` words on, so the cost grows with the matches, not with the product of the lengths.
    """
    best = 0
    rows: list[dict[int, tuple[int, int, int]]] = [{}] * (drop + 1)  # of the last words, by place: score, peak, first word
    for word in doc:
        row: dict[int, tuple[int, int, int]] = {}
        for j in item.at(word):
            found = (0, 0, j)
            for back, above in enumerate(rows):
                for skip in range(drop + 1) if above else ():
                    before = above.get(j - 1 - skip)
                    if before is not None:
                        score = before[0] - max(back, skip)
                        if score > 0 and score >= before[1] - drop and (score, *before[1:]) > found:
                            found = (score, before[1], before[2])
            score = found[0] + 1
            row[j] = (score, max(found[1], score), found[2])
            if score >= least and j - found[2] + 1 > best:
                best = j - found[2] + 1
        rows = [row, *rows[:drop]]
    return best


def leaked(
    docs: DataFrame, items: DataFrame, min_words: int = 12, k: int = 14, window: int = 4, min_hits: int = 2, band: int = 64, item_bound: int = 3_000_000
) -> DataFrame:
    """``doc_id, item_id`` of every document of ``docs`` (``doc_id, text``) that carries ``min_words`` or more consecutive words of an item (``item_id, text``).

    Case, marks, layout, escapes, confused letters and single changed, lost or added words do not matter. Null and empty
    texts and items of fewer words are in no pair; texts are read whole, however long; repeated rows give one pair.

    Method: winnowing keeps the least hash of every ``window`` k-grams of letters, so texts that share ``k + window - 1``
    letters in a row share a fingerprint. Fingerprints of items and documents are joined; hits of one pair on about the
    same diagonal are counted (``min_hits`` different places), and the surroundings of those are aligned word by word. The
    item side is broadcast only while it has at most ``item_bound`` fingerprints; else the join shuffles by hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leak")
    own = scratch.save(_printed(items, "item_id", k, window), "items")
    small = own.count() <= item_bound
    own = own.withColumnsRenamed({"id": "item_id", "pos": "ipos"})
    hits = _printed(docs, "doc_id", k, window).join(F.broadcast(own) if small else own, "hash")
    shift = F.col("pos") - F.col("ipos")
    # Every diagonal lies in two overlapping bands, so that no run of hits is cut by a border.
    bands = hits.select("id", "item_id", "pos", "ipos", F.explode(F.array(F.floor(shift / band) * 2, F.floor((shift + band // 2) / band) * 2 + 1)).alias("band"))
    runs = bands.groupBy("id", "item_id", "band").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("ipos").alias("ilo"), F.max("ipos").alias("ihi"), F.count("*").alias("n"))
    runs = runs.where((F.col("n") >= min_hits) & (F.col("ihi") > F.col("ilo"))).groupBy("id", "item_id").agg(F.collect_set(F.struct("lo", "hi", "ilo", "ihi")).alias("spans"))
    asked = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    pairs = scratch.save(runs, "runs").join(asked, "item_id").join(texts, "id").select("id", "item_id", "spans", "item_text", "text")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        asked: dict[str, Wanted] = {}
        for frame in frames:
            keep = []
            for spans, item, text in zip(frame["spans"], frame["item_text"], frame["text"]):
                if text not in known:
                    known = {text: canonical_words(text)}
                if item not in asked:
                    if len(asked) > 1_000:
                        asked.clear()
                    asked[item] = Wanted(canonical_words(item))
                words, wanted = known[text], asked[item]
                ends = np.cumsum([len(w) for w in words])
                parts: list[list[int]] = []
                for lo, hi in sorted((s["lo"] - 1.3 * s["ilo"] - 30, s["hi"] + 1.3 * (wanted.size - s["ihi"]) + 30) for s in spans):
                    if parts and lo <= parts[-1][1]:
                        parts[-1][1] = max(hi, parts[-1][1])
                    else:
                        parts.append([lo, hi])
                keep.append(
                    len(wanted.words) >= min_words
                    and any(longest_stretch(wanted, words[np.searchsorted(ends, lo) : np.searchsorted(ends, hi) + 1]) >= min_words for lo, hi in parts)
                )
            yield frame.loc[keep, ["id", "item_id"]].rename(columns={"id": "doc_id"})

    return pairs.mapInPandas(extend, "doc_id bigint, item_id bigint").distinct()


def _printed(texts: DataFrame, id: str, k: int, window: int) -> DataFrame:
    """``id, pos, hash`` of the winnowed fingerprints of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 500_000:
                    size, end = size + len(texts[end]), end + 1
                text, places, hashes = fingerprints([canonical_words(t) for t in texts[at:end]], k, window)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + text]), pa.array(places), pa.array(hashes)], names=["id", "pos", "hash"])
                at = end

    rows = texts.where(F.col(id).isNotNull() & (F.length("text") > 0)).select(F.col(id).cast("bigint"), "text")
    return spread(rows).mapInArrow(work, "id bigint, pos int, hash bigint")
