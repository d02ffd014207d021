"""Token ids of a whole corpus under a public byte-level BPE vocabulary, by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that can end its encoding. A suffix automaton over the
vocabulary names all tokens that end at a position; of these the one that is compatible with the last token of the prefix
before it is stored; following the stored tokens back from the end gives the ids. No merge list is replayed over words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import spread

#: Words whose ids, and token pairs whose compatibility, a task keeps at most; beyond that, or beyond so many letters in all, it starts anew.
CACHE, CACHE_LETTERS = 400_000, 8_000_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` vocabulary file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: the ids are not consecutive")
    return [token for _, token in tokens]


class PrefixEncoder:
    """Exact ids of byte strings. ``tokens`` in id order; a lower id is merged earlier."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.rank = {token: n for n, token in enumerate(tokens)}
        self.words = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for n, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (n, len(token)))
        self.automaton.make_automaton()
        self.known: dict[str, list[int]] = {}
        self.letters = 0
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Plain merging of a short string: the definition that compatibility rests on."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], len(self.tokens)))
            both = parts[best] + parts[best + 1]
            if both not in self.rank:
                break
            parts[best : best + 2] = [both]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two tokens when they stand side by side (a = -1: b alone stays one token)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            expected = [self.tokens[b]] if a < 0 else [self.tokens[a], self.tokens[b]]
            found = self.pairs[a, b] = self.merged(b"".join(expected)) == expected
        return found

    def encode_bytes(self, text: bytes) -> list[int]:
        size = len(text)
        last = [-1] * (size + 1)
        for end, (token, length) in self.automaton.iter(text.decode("latin-1")):
            end += 1
            start = end - length
            if last[end] < 0 and (start == 0 or last[start] >= 0) and self.compatible(last[start], token):
                last[end] = token
        out = []
        while size:
            out.append(last[size])
            size -= len(self.tokens[last[size]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one. Surrogates that no encoding has are read as ``?``."""
        if not text:
            return []
        out: list[int] = []
        for word in self.words(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self.encode_bytes(word.encode("utf-8", "replace"))
                self.letters += len(word)
                if len(self.known) >= CACHE or self.letters > CACHE_LETTERS:
                    self.known.clear()
                    self.letters = len(word)
                self.known[word] = ids
            out += ids
        return out


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``, whatever other columns it has; null and empty texts give an empty list.

    One pass without a shuffle: the vocabulary (a file of bounded size, named by its path) is read once, broadcast, and turned
    into an automaton once per Python worker. Rows stay where they were read, so a repeated id gives repeated rows.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(f"{vocabulary}\x1f{pattern}", tokens, pattern)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(work, "doc_id bigint, ids array<int>")


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(key: str, tokens, pattern: str) -> PrefixEncoder:
    """The encoder of this Python worker, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(tokens.value, pattern)
    return _ENCODERS[key]
