"""Numbers of tokens without encoding a frequent word twice, and without moving words.

Byte-level tokenizers cut a text into pre-tokens and encode each by itself, so
a text has as many tokens as its pre-tokens together. Their cuts are found for
a slice of texts at once by array operations over the classes of the
characters (letter, number, white space, other), of which the library itself
is asked, once a character and worker. Then two tiers:

- the frequent pre-tokens of the corpus are in a compact open-addressing table
  (an exact key of 16 bytes, a length), which is broadcast. It has at most
  ``FREQUENT`` entries (about 2.5 MB) at any size of the corpus. Which they are is
  counted over all texts by each task for itself; only a task's ``SUMMARY`` most
  frequent ones leave it, as counts;
- what is not there, or longer than 15 bytes, is encoded by the library once and
  remembered by the worker.

Both tiers hold lengths that the library gave, so the result does not depend on
what is in them. Pre-tokens are never shuffled. A text that holds a string of
the tokenizer's added tokens goes to the library whole, which treats it as it does
by default. SentencePiece models are counted by chunks (see ``pieces``), other
tokenizers by whole texts.

Edge cases: a null text reads as empty and has no tokens; bytes that are not
UTF-8 are counted by ``n_bytes`` and read as U+FFFD each; a task holds one slice
of about 1 MB, or one longer text, with some 60 times its bytes; equal rows give equal
results; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.pieces import Encoder

#: Entries of the broadcast table, pre-tokens that a task reports, bytes of
#: text counted in one go, pre-tokens a worker remembers, characters of the longest of these.
FREQUENT, SUMMARY, SLICE, REMEMBERED, LONGEST = 1 << 16, 1 << 16, 1 << 20, 400_000, 200
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: Bytes that the key of a pre-token has room for; the sixteenth holds its length.
KEY = 15
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _first_of_each(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of different keys (seldom one twice), and which of them each key is."""
    order = np.argsort(_mixed(low, high), kind="stable")
    new = np.ones(len(low), bool)
    new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    back = np.empty(len(low), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class Table:
    """Lengths by exact key, in open addressing with linear probing."""

    def __init__(self, low: np.ndarray, high: np.ndarray, length: np.ndarray):
        size = 1 << max(4, int(2 * len(low)).bit_length())
        self.low, self.high, self.length = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.mask = size - 1
        slots = (_mixed(low, high) >> np.uint64(20)).astype(np.int64) & self.mask
        for i, slot in enumerate(slots.tolist()):
            while self.length[slot]:
                slot = slot + 1 & self.mask
            self.low[slot], self.high[slot], self.length[slot] = low[i], high[i], length[i]

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The length of each key, 0 where it is not known."""
        out, left = np.zeros(len(low), np.int32), np.arange(len(low))
        slot = (_mixed(low, high) >> np.uint64(20)).astype(np.int64) & self.mask
        while len(left):
            hit = (self.low[slot] == low[left]) & (self.high[slot] == high[left])
            length = self.length[slot]
            out[left[hit]] = length[hit]
            on = ~hit & (length > 0)
            left, slot = left[on], slot[on] + 1 & self.mask
        return out


class Cutter:
    """Pre-tokens of a byte-level tokenizer that splits by the usual pattern:
    contractions, letters, numbers, other signs (each with a space before it), white space."""

    def __init__(self, library):
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def _class(self, char: str) -> int:
        """The library keeps a character with others of its class."""
        for number, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split(before + char)) == 1:
                return number
        return SPACE

    def starts(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """At which characters pre-tokens begin; ``bounds``: where texts begin, and the end."""
        n = len(chars)
        of = self.classes[chars]
        if (of == UNKNOWN).any():
            for c in np.unique(chars[of == UNKNOWN]).tolist():
                self.classes[c] = self._class(chr(c))
            of = self.classes[chars]
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        start = first.copy()
        start[1:n] |= of[1:] != of[:-1]
        # The last of the white space before something else stands alone or, a space, leads what follows.
        last = np.flatnonzero((of[:-1] == SPACE) & (of[1:] != SPACE) & ~first[1:n])
        start[last] = True
        start[last[chars[last] == 32] + 1] = False
        # 's, 't, 'm, 'd, 're, 've, 'll where a pre-token begins.
        quote = np.flatnonzero((chars == 39) & start[:n])
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1] & (of[quote + 1] == LETTER)]
        one = chars[quote + 1]
        two = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
        two[first[np.minimum(quote + 2, n)]] = 0
        size = np.where(np.isin(one, [*b"stmd"]), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + 1 + size] |= (quote + 1 + size < n) & (of[np.minimum(quote + 1 + size, n - 1)] == LETTER)
        return np.flatnonzero(start[:n])


class Slice:
    """Texts of one slice: their characters, pre-tokens and the keys of these."""

    def __init__(self, cutter: Cutter, texts: list[str]):
        self.text = "".join(texts)
        self.chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        self.starts = cutter.starts(self.chars, bounds) if len(self.chars) else np.zeros(0, np.int64)
        self.ends = np.concatenate([self.starts[1:], [len(self.chars)]])[: len(self.starts)]
        self.texts_at = np.searchsorted(self.starts, bounds)
        width = (1 + (self.chars >= 0x80).astype(np.uint8) + (self.chars >= 0x800) + (self.chars >= 0x10000)).astype(np.uint8)
        byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        at, size = byte[self.starts], byte[self.ends] - byte[self.starts]
        self.short = np.flatnonzero(size <= KEY)
        data = np.frombuffer(self.text.encode() + bytes(16), np.uint8)
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at, size = at[self.short], size[self.short]
        self.low = words[at] & _BELOW[np.minimum(size, 8)]
        self.high = words[at + 8] & _BELOW[np.maximum(size - 8, 0)] | size.astype(np.uint64) << np.uint64(56)

    def pre_token(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def text_of(low: int, high: int) -> str:
    """The pre-token that a key stands for."""
    return (low.to_bytes(8, "little") + high.to_bytes(8, "little"))[: high >> 56].decode()


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def splits(path: str) -> bool:
    """Whether the tokenizer at ``path`` cuts texts into pre-tokens as ``Cutter`` does."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])) and not spec["model"].get("dropout")
    )


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones stand for themselves, the others are counted up from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Words:
    """The library's tokens of single pre-tokens of a byte-level tokenizer,
    straight from its model: there is nothing left to cut."""

    def __init__(self, library):
        self.tokenize, self.char = library.model.tokenize, {b: c for c, b in byte_values().items()}

    def tokens(self, word: str) -> list:
        return self.tokenize(word.encode().decode("latin-1").translate(self.char))


class Counter:
    """Numbers of tokens of many texts, by the tiers that the tokenizer allows."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.pieces, self.cutter = path.endswith(".model"), None
        if self.pieces:
            self.encoder = Encoder(path)
        else:
            self.library = _library(path)
            self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
            self.cutter, self.words = (Cutter(self.library), Words(self.library)) if splits(path) else (None, None)

    def lengths(self, texts: list[str]) -> list[int]:
        """What the library makes of each text, without added tokens."""
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _remembered(self, words: list[str]) -> list[int]:
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = list(dict.fromkeys(words))
            self.known.update((w, len(self.words.tokens(w))) for w in new)
        found = [self.known[w] for w in words]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return found

    def count(self, texts: list[str], frequent: Table | None = None) -> list[int]:
        if self.pieces:
            return np.diff(self.encoder.encode(texts)[3]).tolist()
        if self.cutter is None:
            return self.lengths(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if whole:
            texts = list(texts)
            apart = self.lengths([texts[i] for i in whole])
            for i in whole:
                texts[i] = ""
        s = Slice(self.cutter, texts)
        n = np.zeros(len(s.starts), np.int64)
        if frequent is not None:
            n[s.short] = frequent.find(s.low, s.high)
        # Short misses repeat within the slice: one of each is looked up.
        missed = n[s.short] == 0
        at, one, back = s.short[missed], *_first_of_each(s.low[missed], s.high[missed])
        n[at] = np.array(self._remembered([s.pre_token(i) for i in at[one].tolist()]), np.int64)[back]
        long = np.flatnonzero(n == 0)
        n[long] = self._remembered([s.pre_token(i) for i in long.tolist()])
        total = np.concatenate([[0], np.cumsum(n)])
        out = np.diff(total[s.texts_at])
        if whole:
            out[whole] = apart
        return out.tolist()


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of slices of about ``SLICE`` bytes."""
    column = column.cast(pa.binary()).fill_null(b"")
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(column)).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def _summaries(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The most frequent short pre-tokens of each task; rare ones that were
    dropped on the way begin to be counted anew."""

    def merged(parts: list[tuple]) -> tuple:
        low, high, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, one, back = np.unique(_mixed(low, high), return_index=True, return_inverse=True)
        total = np.bincount(back, n, len(one)).astype(np.int64)
        top = np.argsort(-total, kind="stable")[: 4 * SUMMARY]
        return low[one[top]], high[one[top]], total[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, parts = _counter(path).cutter, []
        for batch in batches:
            for _, raw in _slices(batch.column(0)):
                s = Slice(cutter, [x.decode("utf-8", "each_byte") for x in raw])
                _, one, n = np.unique(_mixed(s.low, s.high), return_index=True, return_counts=True)
                parts.append((s.low[one], s.high[one], n))
                if len(parts) > 16:
                    parts = [merged(parts)]
        if parts:
            low, high, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(x[:SUMMARY].view(np.int64)) for x in (low, high, n)], names=["low", "high", "n"])

    return run


def frequent(docs: DataFrame, path: str) -> Table | None:
    """The table of the corpus's frequent pre-tokens, at most ``FREQUENT`` of
    them whatever the corpus; None for a tokenizer without pre-tokens."""
    if not splits(path):
        return None
    seen = docs.select("text").mapInArrow(_summaries(path), "low long, high long, n long")
    top = seen.groupBy("low", "high").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "low", "high").limit(FREQUENT).collect()
    keys = [(r["low"] % (1 << 64), r["high"] % (1 << 64)) for r in top]
    words = Words(_library(path))
    lengths = [len(words.tokens(text_of(*k))) for k in keys]
    both = np.array(keys, np.uint64).reshape(-1, 2)
    return Table(both[:, 0], both[:, 1], np.array(lengths, np.int32))


def counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``.

    ``path``: the tokenizer's file (.json or .model), the same on every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            size, n = [], []
            for _, raw in _slices(batch.column(1)):
                size += map(len, raw)
                n += counter.count([x.decode("utf-8", "each_byte") for x in raw], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
