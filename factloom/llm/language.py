"""Languages of texts and of the stretches within them, by hyperdimensional n-gram profiles."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch
from factloom.session import spread

# What labels call the languages, unless the caller names others.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "ingles"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "aleman"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
}

_FENCE = re.compile(r"^\s*(```|~~~)")
_CODE_START = re.compile(
    r"\s*(?:def |class |import |from \S+ import|return\b|assert\b|for \S+(?:, \S+)* in |while |if .*[:{]\s*(?:\S+.*)?$|elif |else:|try:|except|with .*:$|export |const |let |var |function |public |private |SELECT |INSERT |UPDATE |FAILED |PASSED |ERROR |at \S+\("
    r"|\[\d+/\d+\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d)"
)
_CODE_SIGN = re.compile(r"[{};=>+:()]")
_CODE = re.compile(r"[{};]\s*$|==|=>|->|\+=|-=|::|\w=\S|\(\)")
_MARK = re.compile(r"^\s*(?:#+|//+|--+|\*+|>+|•|/\*+|[-+]|\d+[.)])\s+")
_ASIDE = re.compile(r"`[^`]*`|\[[^\]]*\]|\((?:#|0x)[^)]*\)")
_ODD = re.compile(r"[_/\\@#=<>{}|\d]|\w\.\w|\b[a-z]+[A-Z]")
_SIGN = re.compile(r"[_/\\@#=<>{}|\d]")
_DOTTED = re.compile(r"\b\w+(?:\.\w+)+\b|\b[a-z]+[A-Z]\w*|\b[A-Z]{2,}-\d+\b")
_SPEAKER = re.compile(r"\s*[a-z]\.[a-z]+\d*:\s+")
_CLOSING = "\"'”»)"
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def label_language(label: str | None, names: dict[str, tuple[str, ...]] = NAMES) -> str | None:
    """The language that a label names in whatever spelling, or None."""
    if not label:
        return None
    name = unicodedata.normalize("NFC", label).strip().lower()
    first = re.split(r"[-_ (]", name)[0]
    return next((lang for lang, spelt in names.items() if name in spelt), None) or next((lang for lang, spelt in names.items() if first in spelt), None)


def _prose(text: str) -> list[str]:
    """The lines of running text: no front matter, fenced code, code lines, log lines or headings; of JSON the longer values."""
    stripped = text.strip()
    if stripped[:1] in "{[":
        try:
            found: list[str] = []
            todo = [json.loads(stripped)]
            while todo:
                value = todo.pop(0)
                if isinstance(value, dict):
                    todo[:0] = list(value.values())
                elif isinstance(value, list):
                    todo[:0] = value
                elif isinstance(value, str) and " " in value:
                    found.append(value)
            return [line for value in found for line in _prose(value)] if found and found != [text] else found
        except ValueError:
            pass
    lines = re.split(r"\r\n|\n|\r|\x85|\u2028|\u2029", text)
    if lines and lines[0].strip() == "---":
        close = next((n for n, line in enumerate(lines[1:], 1) if line.strip() == "---"), 0)
        lines = lines[close + 1 :] if close else lines
    out, fenced = [], False
    for line in lines:
        if _FENCE.match(line):
            fenced = not fenced
            continue
        marked = _MARK.match(line)
        body = line[marked.end() :] if marked else line
        if fenced or not body.strip():
            out.append("")
        elif marked and marked.group(0).strip().startswith("#") and not re.search(r"[.!?…][\"'”»)]*(?:\s|$)", body):
            out.append("")
        elif _is_code(body) and not _SENTENCE.search(body):
            out.append("")
        else:
            out.append(body)
    return out


#: A line that holds five plain words in a row and an end of sentence is running text whatever else stands in it.
_SENTENCE = re.compile(r"(?:(?<![\w(])[^\W\d_]+['’,]?[^\W\d_]*,? ){4}.*[^\W_][.!?…][\"'”»)]*(?:\s|$)")
#: Asides in running text that look like code.
_NOISE_KEEP = re.compile(r"`[^`]*`|\[[^\]]*\]|\([^)]*\)|\"[^\"]*\"")


def _is_code(line: str) -> bool:
    if any(c in line for c in '`[("'):
        line = _NOISE_KEEP.sub(" ", line)
    return bool(_CODE_START.match(line) or (_CODE_SIGN.search(line) and _CODE.search(line)))


def _plain(part: str) -> str:
    """A sentence without its speaker, asides, identifiers, paths and numbers."""
    if _SPEAKER.match(part):
        part = _SPEAKER.sub("", part, count=1)
    if any(c in part for c in "`[("):
        part = _ASIDE.sub(" ", part)
    if _ODD.search(part):
        part = " ".join([w if not _ODD.search(w) else "" if _SIGN.search(w) else _DOTTED.sub(" ", w) for w in part.split()])
    return part


def sentences(text: str | None, least_words: int = 3, least_letters: int = 12) -> list[str]:
    """The sentences of a text in order, lower case, letters and blanks only, without identifiers, paths, numbers and names of speakers.

    A sentence ends in a full stop, question or exclamation mark and keeps at least ``least_words`` words; lines that were wrapped are one sentence.
    """
    if not text:
        return []
    out, block = [], ""
    for line in [*_prose(text), ""]:
        if line:
            block = f"{block} {line}".strip()
            continue
        for part in _END.split(block) if block else ():
            if not part.strip().rstrip(_CLOSING).endswith((".", "!", "?", "…")):
                continue
            low = _plain(part).lower()
            words = _LETTERS.findall(low if low.isascii() else unicodedata.normalize("NFC", low))
            if len(words) >= least_words and sum(map(len, words)) >= least_letters:
                out.append(" ".join(words))
        block = ""
    return out


def _words(text: str | None) -> list[str]:
    """All words of a text as one sentence; none if it has none."""
    words = _LETTERS.findall(unicodedata.normalize("NFC", (text or "").lower()))
    return [" ".join(words)] if words else []


class Profiles:
    """Random letter vectors of +1 and -1, permuted by their place and multiplied into n-gram vectors, which are bundled into profiles.

    A vector is kept as bits (set: -1), so a product is an exclusive or. N-grams of whole batches of texts are numbered at once: one is four
    letters of 16 bits (letters beyond those share the private ones).
    """

    N = 4

    def __init__(self, dim: int = 2048, seed: int = 11):
        self.dim, self.seed = dim, seed
        self._rows: dict[int, int] = {}
        self._turned = np.empty((self.N, 0, dim // 8), np.uint8)
        self._against: np.ndarray | None = None
        self._known, self._scores = np.empty(0, np.uint64), np.empty((0, 0), np.float32)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of all texts, the number of each occurrence's n-gram, and where each text's occurrences begin. A blank stands before and after every text."""
        joined = "".join([f" {t} \n" for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        codes = np.where(codes > 0xFFFF, 0xE000 + codes % 0x1900, codes).astype(np.uint64)
        n = len(codes) - self.N + 1
        keys, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.N):
            keys = (keys << np.uint64(16)) | codes[k : k + n]
            whole &= codes[k : k + n] != 10
        starts = np.concatenate([[0], np.cumsum([max(0, len(t) + 3 - self.N) for t in texts])[:-1]]).astype(np.int64)
        distinct, number = np.unique(keys[whole], return_inverse=True)
        return distinct, number, starts

    def bound(self, distinct: np.ndarray) -> np.ndarray:
        """The vectors of n-grams as bits."""
        letters = np.stack([(distinct >> np.uint64(16 * (self.N - 1 - k))) & np.uint64(0xFFFF) for k in range(self.N)]).astype(np.int64)
        fresh = [c for c in np.unique(letters).tolist() if c not in self._rows]
        if fresh:
            for c in fresh:
                self._rows[c] = len(self._rows)
            plain = np.stack([np.random.default_rng([self.seed, c]).integers(0, 2, self.dim, dtype=np.uint8) for c in fresh])
            turned = np.stack([np.packbits(np.roll(plain, self.N - 1 - k, axis=1), axis=1) for k in range(self.N)])
            self._turned = np.concatenate([self._turned, turned], axis=1)
        names, back = np.unique(letters, return_inverse=True)
        rows = np.array([self._rows[c] for c in names.tolist()], np.int64)[back.reshape(letters.shape)]
        out = self._turned[0][rows[0]]
        for k in range(1, self.N):
            out ^= self._turned[k][rows[k]]
        return out

    def bundle(self, distinct: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each row of ``counts`` (one count per distinct n-gram) the sum of the n-gram vectors, each as often as it is counted."""
        out = np.repeat(counts.sum(axis=1, keepdims=True), self.dim, axis=1).astype(np.float64)
        for at in range(0, len(distinct), 4096):
            bits = np.unpackbits(self.bound(distinct[at : at + 4096]), axis=1)
            out -= 2 * (counts[:, at : at + 4096].astype(np.float32) @ bits.astype(np.float32))
        return out

    def cosines(self, texts: list[str], prototypes: np.ndarray) -> np.ndarray:
        """Cosine of the profile of every text with unit prototypes.

        A dot product with a bundle is the sum of those with its n-grams, which are kept from batch to batch; n-gram vectors
        are as good as orthogonal, so the bundle's length follows from their counts.
        """
        if self._against is not prototypes or len(self._known) > 400_000:
            self._against, self._known, self._scores = prototypes, np.empty(0, np.uint64), np.empty((0, len(prototypes)), np.float32)
        distinct, number, starts = self.grams(texts)
        at = np.searchsorted(self._known, distinct)
        new = distinct[self._known[np.minimum(at, len(self._known) - 1)] != distinct] if len(self._known) else distinct
        if len(new):
            parts = [np.unpackbits(self.bound(new[k : k + 4096]), axis=1).astype(np.float32) @ prototypes.T for k in range(0, len(new), 4096)]
            scores = prototypes.sum(axis=1)[None, :] - 2 * np.concatenate(parts)
            order = np.argsort(np.concatenate([self._known, new]), kind="stable")
            self._known, self._scores = np.concatenate([self._known, new])[order], np.concatenate([self._scores, scores])[order]
            at = np.searchsorted(self._known, distinct)
        dots = np.add.reduceat(self._scores[at][number], starts, axis=0)
        text = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(number))))
        pairs, counts = np.unique(text * len(distinct) + number, return_counts=True)
        squares = np.bincount(pairs // len(distinct), weights=counts.astype(np.float64) ** 2, minlength=len(texts))
        return dots / np.sqrt(self.dim * np.maximum(squares, 1e-9))[:, None]


_PROFILES: dict[int, Profiles] = {}
#: Letters that are scored at once.
_CHUNK = 200_000


def _profiles(dim: int) -> Profiles:
    """The profile maker of this Python worker, kept from task to task with the letter vectors and scores it has made."""
    if dim not in _PROFILES:
        _PROFILES.clear()
        _PROFILES[dim] = Profiles(dim)
    return _PROFILES[dim]


def _chunks(found: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have some :data:`_CHUNK` letters."""
    start = size = 0
    for n, parts in enumerate(found):
        size += sum(map(len, parts))
        if size >= _CHUNK:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(found):
        yield start, len(found)


def stretches(cosines: np.ndarray, stay: float = 0.06) -> list[int]:
    """The most likely language of every sentence when a change of language costs ``stay`` cosine."""
    n, m = cosines.shape
    best = cosines.argmax(axis=1)
    if (best == best[0]).all():
        return best.tolist()
    total, back = cosines[0].copy(), np.zeros((n, m), int)
    for i in range(1, n):
        jump = int(total.argmax())
        back[i] = np.where(total >= total[jump] - stay, np.arange(m), jump)
        total = np.maximum(total, total[jump] - stay) + cosines[i]
    path = [int(total.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def _leads(cosines: np.ndarray, path: list[int]) -> np.ndarray:
    """By how much every sentence's language leads over the next one; 1 where there is but one language."""
    if cosines.shape[1] < 2:
        return np.ones(len(path))
    at, rest = np.arange(len(path)), cosines.copy()
    rest[at, path] = -2
    return cosines[at, path] - rest.max(axis=1)


def fit(docs: DataFrame, sample: int = 6_000, dim: int = 2048, epochs: int = 4, names: dict[str, tuple[str, ...]] = NAMES) -> tuple[list[str], np.ndarray]:
    """Language prototypes from at most about ``sample`` labelled rows (a fixed hash share of them; all if there are fewer).

    The languages are those of ``names`` that labels name. The first prototypes bundle the sentences of documents by label; the second
    only those sentences on which the first agree with the label, which removes wrong labels and foreign stretches. Then, ``epochs``
    times, sentences that are told by little or just missed, in documents that mostly agree with their label, are added to their
    prototype and taken from the one they were confused with. Partial bundles are summed per task; what reaches the driver is one
    vector per language and task of a bounded sample.
    """
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    total = labelled.count()
    if total > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    scratch = Scratch(docs.sparkSession, "language")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [label_language(label, names) for label in batch.column(0).to_pylist()]
            parts = [sentences(text) if lang else [] for lang, text in zip(langs, batch.column(1).to_pylist())]
            keep = [n for n, p in enumerate(parts) if p]
            yield pa.RecordBatch.from_arrays([pa.array([langs[n] for n in keep], pa.string()), pa.array([parts[n] for n in keep], pa.list_(pa.string()))], names=["lang", "parts"])

    few = min(docs.sparkSession.sparkContext.defaultParallelism, max(1, sample // 250))
    table = scratch.save(labelled.repartition(few, "doc_id").select("lang", "text").mapInArrow(split, "lang string, parts array<string>"), "sample")
    sums = _bundle(table, dim, None)
    order = list(names)
    for turn in range(epochs + 1):
        found = [lang for lang in order if lang in sums]
        if len(found) < 2:
            break
        judge = docs.sparkSession.sparkContext.broadcast((found, _centred(np.array([sums[lang] for lang in found])).astype(np.float32), turn == 0))
        change = _bundle(table, dim, judge)
        sums = change if turn == 0 else {lang: sums[lang] + 3 * change.get(lang, 0) for lang in found}
    scratch.clear()
    found = [lang for lang in order if lang in sums]
    return found, _centred(np.array([sums[lang] for lang in found], float).reshape(len(found), dim))


def _centred(sums: np.ndarray) -> np.ndarray:
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
    return unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)


def _bundle(labelled: DataFrame, dim: int, judge) -> dict[str, np.ndarray]:
    """Sums of sentence profiles by language: by label alone, by label where the judge agrees, or the judge's corrections."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _profiles(dim)
        for batch in batches:
            langs, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t for p in parts for t in p]
            if not texts:
                continue
            ends = np.cumsum([len(p) for p in parts])
            if judge is None:
                found = sorted(set(langs))
            else:
                found, prototypes, filtering = judge.value
            own = np.repeat([found.index(lang) if lang in found else -1 for lang in langs], np.diff(np.append(0, ends)))
            weight = np.zeros((len(found), len(texts)), np.float32)
            at = np.arange(len(texts))
            if judge is None:
                weight[own, at] = 1
            else:
                cosines = np.concatenate([maker.cosines(sum(parts[a:b], []), prototypes) for a, b in _chunks(parts)])
                agree = (cosines.argmax(axis=1) == own) & (own >= 0)
                if filtering:
                    weight[own[agree], at[agree]] = 1
                else:
                    share = np.repeat(np.add.reduceat(agree, ends - [len(p) for p in parts]) / np.diff(np.append(0, ends)), np.diff(np.append(0, ends)))
                    mine = cosines[at, own].copy()
                    cosines[at, own] = -2
                    other = cosines.argmax(axis=1)
                    lead = mine - cosines[at, other]
                    turned = np.nonzero((share >= 0.6) & (own >= 0) & (lead < 0.05) & (lead > -0.12))[0]
                    weight[own[turned], turned] = 1
                    weight[other[turned], turned] = -1
            used = np.nonzero(weight.any(axis=0))[0]
            if not len(used):
                continue
            distinct, number, starts = maker.grams([texts[n] for n in used])
            text = np.repeat(used, np.diff(np.append(starts, len(number))))
            counts = np.stack([np.bincount(number, weights=row[text], minlength=len(distinct)) for row in weight])
            there = [k for k, row in enumerate(counts) if row.any()]
            vectors = np.rint(maker.bundle(distinct, counts[there]))
            yield pa.RecordBatch.from_arrays([pa.array([found[k] for k in there]), pa.array(vectors.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["lang", "v"])

    rows = labelled.mapInArrow(work, "lang string, v array<bigint>").toPandas()
    total: dict[str, np.ndarray] = {}
    for lang, v in zip(rows["lang"], rows["v"]):
        total[lang] = total.get(lang, 0) + np.asarray(v, float)
    return total


def segments(
    docs: DataFrame, langs: list[str], prototypes: np.ndarray, stay: float = 0.06, trust: float = 0.04, whole: bool = False, names: dict[str, tuple[str, ...]] = NAMES
) -> DataFrame:
    """``doc_id, label, seg, lang, n, confidence, n_segs`` of every stretch of sentences in one language, in text order.

    ``label`` is the language that ``docs.lang`` names (null if none); ``n`` the sentences of the stretch; ``confidence`` the mean lead in
    cosine over the next language. The language that a label names has an advantage of ``trust`` cosine, which decides where a sentence tells
    little. A text without a sentence (null and empty ones too) has no stretch; with ``whole`` it has one row with ``n`` 0: the language of
    all its words, or a null language with confidence 0 if it has none. One pass, no shuffle; texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32()]
    columns = ["doc_id", "label", "seg", "lang", "n", "confidence", "n_segs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        maker, labels = _profiles(matrix.shape[1]), {}
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for label in set(batch.column(1).to_pylist()) - labels.keys():
                labels[label] = label_language(label, names)
            named = [labels[label] for label in batch.column(1).to_pylist()]
            found = [sentences(t) if known else [] for t in texts]
            count = [len(p) for p in found]
            if whole and known:
                found = [p or _words(t) for p, t in zip(found, texts)]
            for a, b in _chunks(found):
                out: list[list] = [[] for _ in columns]
                flat = [s for p in found[a:b] for s in p]
                cosines = maker.cosines(flat, matrix) if flat else np.empty((0, len(known)))
                at = 0
                for n in range(a, b):
                    mine = cosines[at : at + len(found[n])]
                    at += len(found[n])
                    if not len(mine):
                        if whole:
                            for column, value in zip(out, (docs_[n], named[n], 0, None, 0, 0.0, 1)):
                                column.append(value)
                        continue
                    if named[n] in known:
                        mine[:, known.index(named[n])] += trust
                    path = stretches(mine, stay)
                    lead = _leads(mine, path)
                    cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
                    for seg, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (docs_[n], named[n], seg, known[path[i]], (j - i) * bool(count[n]), float(lead[i:j].mean()), len(cuts) - 1)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=columns)

    rows = docs.where("doc_id IS NOT NULL" if whole else "doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "lang", "text")
    return spread(rows).mapInArrow(work, "doc_id bigint, label string, seg int, lang string, n int, confidence double, n_segs int")


def languages(docs: DataFrame, sample: int = 6_000, names: dict[str, tuple[str, ...]] = NAMES) -> DataFrame:
    """``doc_id, seg, lang, confidence, n_sentences`` of every stretch of every document (``doc_id, text, lang``), also of those without a sentence (see :func:`segments`)."""
    langs, prototypes = fit(docs, sample, names=names)
    found = segments(docs, langs, prototypes, whole=True, names=names)
    return found.select("doc_id", "seg", "lang", F.round("confidence", 6).alias("confidence"), F.col("n").alias("n_sentences"))


def wrong_labels(docs: DataFrame, sample: int = 6_000, names: dict[str, tuple[str, ...]] = NAMES) -> DataFrame:
    """``doc_id, seg, lang`` of the documents (``doc_id, text, lang``) whose label is missing or wrong or that mix languages: one row per stretch.

    A right label in another spelling is no case; neither is a text without any sentence, a null or an empty one. A
    ``doc_id`` is taken to be unique; rows that repeat one are read apart.
    """
    langs, prototypes = fit(docs, sample, names=names)
    found = segments(docs, langs, prototypes, names=names)
    return found.where("label IS NULL OR label <> lang OR n_segs > 1").select("doc_id", "seg", "lang")
