"""Alignment of the tokens of two tokenizers, worked out once per distinct segment.

A text splits before white space into segments, wherever the two vocabularies
show that no token can reach over: no entry of either has that white space
behind anything else, and the first tokenizer's pattern never looks back over
it. Then tokens of a segment, and the places where tokens of both end, are the
same wherever it stands.

1. Each task replaces the segments of some ``BLOCK`` bytes of consecutive texts by
   numbers; a block is its list of distinct segments, how often each occurs, and,
   per document, an array of numbers. This is written to the shared folder; texts are not needed any more.
2. The distinct segments of all blocks are tokenised and aligned once. How often ids
   are linked in the corpus is a sum over them, less what documents hold that have
   no tokens.
3. Alignments are joined back to the blocks by segment (a segment occurs at most
   once in a block, so a frequent one is spread by its blocks).
4. Documents meet their block's alignments, which are put together.

A task holds a block and its list of segments, never more; one document that is
longer than a block is a block of its own. Where the vocabularies do not allow
splits, each text is one segment, and the result is the same.

The first tokenizer is a byte-level one (``tokenizers``, .json) that gets a
space before the text, the second a SentencePiece model, which puts one itself.
Strings of special tokens are ordinary text to both.

Edge cases: null and empty texts, texts that are not UTF-8 and texts whose
bytes the tokens of either do not give back have no tokens; rows with one id are
documents of their own; a row without id is kept; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Tables, table
from millrace.llm.pieces import MARK, Normalizer, default_model
from millrace.llm.token_counts import Cutter, Slice, Words, _library, byte_values, splits

#: Bytes of text whose segments are numbered together; segments aligned in one go; pre-tokens a worker remembers; bytes of a batch of results.
BLOCK, SEGMENTS, REMEMBERED, PART = 1 << 25, 1 << 14, 1 << 16, 1 << 22
#: White space at which texts may be split, if the vocabularies allow it.
BREAKS = " \t\n\x0b\x0c\r"
#: Everything that either tokenizer may take for white space.
WHITE = BREAKS + "\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: What stands between the ids of a group's first and second side, between the two, and after a group.
SIGNS = ".,|;"
#: Alignments that a task sends to their blocks in one go, about.
GATHERED = 1 << 18
#: Copies of a pair's count for the join with segments, of which a frequent pair has many.
COPIES = 16


class Pair:
    """Both tokenizers, the bytes of their tokens, and where texts may be split."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.first, self.norm = _library(first), Normalizer(second)
        self.first.encode_special_tokens = True
        value = byte_values()
        names = self.first.get_vocab(with_added_tokens=False)
        self.first_bytes = {i: bytes(value[c] for c in name) for name, i in names.items()}
        self.second_bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, kind in self.norm.pieces]
        self.plain = self.norm.bpe and self.norm.prefix and self.norm.escape and not (self.norm.squeeze or self.norm.suffix or self.norm.own or self.norm.map.units)
        self.breaks = self._breaks(first)
        self.known: dict[str, list[int]] = {}
        self.first_size = np.zeros(max(self.first_bytes) + 2, np.int64)
        for i, b in self.first_bytes.items():
            self.first_size[i] = len(b)
        self.second_size = np.array([len(b) for b in self.second_bytes], np.int64)
        self.cutter, self.words = (Cutter(self.first), Words(self.first)) if self.breaks else (None, None)
        self.second = self.norm.segmenter() if self.plain else sentencepiece.SentencePieceProcessor(model_proto=self.norm.model)

    def _breaks(self, first: str) -> str:
        """The white space before which no token of either reaches, if it follows
        something else. ``splits``: the first one's pattern ends before white space."""
        if not self.plain or not splits(first) or any(not t.special for t in self.first.get_added_tokens_decoder().values()):
            return ""
        entries = [b.decode(errors="replace") for b in self.first_bytes.values()] + [p.replace(MARK, " ") for p, kind in self.norm.pieces if kind != 6]
        free = []
        for w in BREAKS:
            over = re.compile(f"[^{re.escape(WHITE)}]{re.escape(w)}")
            if not any(map(over.search, entries)):
                free.append(w)
        return "".join(free)

    def splitter(self) -> Callable[[str], list[str]]:
        """Segments of a text: any white space, then what follows it, up to the next break."""
        if not self.breaks:
            return lambda text: [text]
        white, inner = re.escape(WHITE), re.escape("".join(c for c in WHITE if c not in self.breaks))
        return re.compile(f"[{white}]*[^{white}]+(?:[{inner}][{white}]*[^{white}]*)*|[{white}]+").findall

    def _first_ids(self, segments: list[str]) -> list[list[int]]:
        if self.cutter is None:
            return [e.ids for e in self.first.encode_batch_fast(segments, add_special_tokens=False)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        s, known, tokens, out = Slice(self.cutter, segments), self.known, self.words.tokens, []
        words = [s.text[a:b] for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
        for w in words:
            if w not in known:
                known[w] = [t.id for t in tokens(w)]
        for a, b in pairwise(s.texts_at.tolist()):
            out.append(known[words[a]] if b == a + 1 else [i for w in words[a:b] for i in known[w]])
        return out

    def align(self, segments: list[str]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """Of each segment: ids of its groups, four times each and the place in ``SIGNS`` of
        the sign after it, packed, None if its bytes do not come back; then all pairs of ids whose
        ends meet, as one number each, and where each segment's begin among them."""
        a_ids = self._first_ids(segments)
        b_ids = self.second.encode([s.replace(" ", MARK) for s in segments] if self.plain else [s[1:] for s in segments], num_threads=1)
        # A token added to the vocabulary has no bytes here; a text cannot give one.
        a_of, b_of = lambda i: self.first_bytes.get(i, b""), self.second_bytes.__getitem__
        data = [s.encode() for s in segments]
        right = np.ones(len(segments), bool)
        if b"".join(map(a_of, chain.from_iterable(a_ids))) != b"".join(data) or b"".join(map(b_of, chain.from_iterable(b_ids))) != b"".join(data):
            right = np.fromiter((b"".join(map(a_of, a)) == d == b"".join(map(b_of, b)) for a, b, d in zip(a_ids, b_ids, data, strict=True)), bool, len(data))
            a_ids, b_ids = ([x if r else [] for x, r in zip(ids, right.tolist(), strict=True)] for ids in (a_ids, b_ids))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.first_size[a]), np.cumsum(self.second_size[b])
        met, a_last, b_last = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        stop = np.cumsum(np.where(right, np.fromiter(map(len, data), np.int64, len(data)), 0))
        first_link = np.concatenate([[0], np.searchsorted(met, stop, side="right")])
        # Within the whole, a token stands behind all tokens of earlier groups, and one of the second behind its group's first.
        a_group, b_group = np.searchsorted(met, a_end), np.searchsorted(met, b_end)
        a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group)
        b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
        sign = np.zeros(len(a) + len(b), np.int64)
        sign[b_at] = 1
        sign[a_at[a_last]], sign[b_at[b_last]] = 2, 3
        ids = np.empty(len(a) + len(b), np.int64)
        ids[a_at], ids[b_at] = a, b
        data = packed((ids * 4 + sign).astype(np.int32))
        ends = np.concatenate([[0], np.flatnonzero(data < 128) + 1])
        data, bounds = data.tobytes(), ends[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        groups = [data[i:j] if r else None for (i, j), r in zip(pairwise(bounds), right.tolist(), strict=True)]
        return groups, a[a_last] << 32 | b[b_last], first_link


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(first: str, second: str) -> Pair:
    if (first, second) not in _pairs:
        _pairs[first, second] = Pair(first, second)
    return _pairs[first, second]


class _Numbers(dict):
    """Numbers in the order in which segments are first asked for."""

    def __missing__(self, segment: str) -> int:
        number = self[segment] = len(self)
        return number


def packed(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 28 as bytes, seven bits each, the last without its highest bit."""
    size = (1 + (numbers >= 1 << 7).view(np.uint8) + (numbers >= 1 << 14) + (numbers >= 1 << 21)).astype(np.uint8)
    at = np.cumsum(size, dtype=np.int32) - size
    out = np.empty(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        some = np.flatnonzero(size > k).astype(np.int32) if k else slice(None)
        out[at[some] + k] = numbers[some] >> 7 * k & 127 | (size[some] > k + 1) * np.uint8(128)
    return out


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128).astype(np.int32)
    first = np.empty_like(last)
    first[:1], first[1:] = 0, last[:-1] + 1
    out = (data[first] & 127).astype(np.int32)
    for k in range(1, 4):
        some = np.flatnonzero(last - first >= k)
        out[some] |= (data[first[some] + k] & 127).astype(np.int32) << 7 * k
    return out


def _spelled(groups: pa.Array) -> tuple[list[str], dict[str, np.ndarray]]:
    """Packed groups as text, the ids of a side parted by commas, and how many groups
    and ids of each side they have."""
    data = np.frombuffer(b"".join(x or b"" for x in groups.to_pylist()), np.uint8)
    size = np.asarray(pa.compute.binary_length(groups).fill_null(0)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(data < 128)])[np.concatenate([[0], np.cumsum(size)])]
    coded = unpacked(data)
    sign = coded & 3
    so_far = {c: np.concatenate([[0], np.cumsum(sign == i)])[ends] for i, c in enumerate(SIGNS)}
    n = {c: np.diff(x) for c, x in so_far.items()}
    shown = sign.copy()
    shown[ends[1:][np.diff(ends) > 0] - 1] = 4  # nothing after the last
    parts = pa.compute.binary_join_element_wise(pa.array(coded >> 2).cast(pa.string()), pa.array([",", ",", "|", ";", ""]).take(pa.array(shown)), "")
    texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), parts), "").to_pylist()
    return texts, {"n_groups": n["|"], "n_a": n["."] + n["|"], "n_b": n[","] + n["|"]}


def _sent(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the segments of all documents, and where each document's end."""
    column = docs.column("segments").combine_chunks()
    lengths = np.asarray(pa.compute.binary_length(column)).astype(np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(data < 128, dtype=np.int32)])
    return unpacked(data), ends[np.cumsum(lengths)].astype(np.int64)


def _blocks(first: str, second: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _pair(first, second).splitter()
        block, held, numbers, lists, ids = TaskContext.get().partitionId() << 32, 0, _Numbers(), [], []
        names, none = ["block", "doc_id", "segments", "words", "times"], np.zeros(0, np.int32)

        def done() -> Iterator[pa.RecordBatch]:
            """The documents of a block and its segments, frequent ones first: they get short numbers."""
            flat, n = np.concatenate([none, *lists]), len(lists)
            times = np.bincount(flat, minlength=len(numbers))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            sizes, lists[:] = [len(x) for x in lists], []
            data = packed(place[flat])
            ends = np.concatenate([[0], np.cumsum(data < 128, dtype=np.int32)])
            ends = np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            segments = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(ids, pa.int64()), segments, pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            words = pa.array(list(numbers), pa.string()).take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays([0, len(words)], words), pa.array([times[order]], pa.list_(pa.int64()))], names=names
            )

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = raw.as_py() or b""
                if held and held + len(raw) > BLOCK:
                    yield from done()
                    pa.default_memory_pool().release_unused()
                    block, held, numbers, lists, ids = block + 1, 0, _Numbers(), [], []
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = ""
                lists.append(np.array(list(map(numbers.__getitem__, split(" " + text))), np.int32) if text else none)
                ids.append(doc_id)
                held += len(raw)
        if ids:
            yield from done()
            numbers, lists, ids = _Numbers(), [], []
            pa.default_memory_pool().release_unused()

    return run


def _aligned(first: str, second: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for batch in batches:
            for i in range(0, len(batch), SEGMENTS):
                part, times = batch.column(0).slice(i, SEGMENTS), batch.column(1).slice(i, SEGMENTS)
                groups, links, at = pair.align(part.to_pylist())
                yield pa.RecordBatch.from_arrays([part, times, pa.array(groups, pa.binary()), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(links))], names=["segment", "times", "groups", "links"])

    return run


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all, then the second ones: they
    compress well, as the high ones are mostly zero."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments of one block that come by in a row of columns: numbers as steps,
    sizes of groups (0 where there are none, else one more) and the rest."""
    names, held = ["home", "number", "size", "n_best", "count_sum", "groups"], []

    def rows() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(pa.array(np.lexsort((t["number"].to_numpy(), t["home"].to_numpy())))).combine_chunks()
        home, number, n_best, count_sum = (t[c].to_numpy() for c in ("home", "number", "n_best", "count_sum"))
        groups = t["groups"].combine_chunks()
        size = np.asarray(pa.compute.binary_length(groups).fill_null(-1)).astype(np.int64) + 1
        at, data = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]), b"".join(x or b"" for x in groups.to_pylist())
        homes, first = np.unique(home, return_index=True)
        out = [[] for _ in names[1:]]
        for i, j in pairwise([*first.tolist(), len(home)]):
            for o, v in zip(out, (planes(np.diff(number[i:j], prepend=0)), planes(size[i:j]), planes(n_best[i:j]), planes(count_sum[i:j]), data[at[i] : at[j]]), strict=True):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(homes), *(pa.array(o, pa.binary()) for o in out)], names=names)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED or sum(b.nbytes for b in held) >= BLOCK:
            yield rows()
            held.clear()
    if sum(map(len, held)):
        yield rows()


def _left_out(docs: pa.Table, wrong: pa.Table) -> pa.Table:
    """How often a block's documents that have a wrong segment have each segment."""
    if not len(docs) or not len(wrong):
        return pa.table({"home": pa.array([], pa.int64()), "number": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    flat, ends = _sent(docs)
    so_far = np.concatenate([[0], np.cumsum(np.isin(flat, np.asarray(wrong.column("number").combine_chunks())))])
    sizes = np.diff(np.concatenate([[0], ends]))
    bad = so_far[ends] > so_far[ends - sizes]
    number, n = np.unique(flat[np.repeat(bad, sizes)], return_counts=True)
    return pa.table({"home": np.full(len(number), docs.column("block")[0].as_py()), "number": number.astype(np.int32), "n": n.astype(np.int64)})


def _composed(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The alignment of each document of a block."""
    number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unplaned(x)) for x in words.column("number").to_pylist())])
    order = np.argsort(number)
    column = lambda name: np.concatenate([np.zeros(0, np.int64), *map(unplaned, words.column(name).to_pylist())])[order]
    size = np.concatenate([np.zeros(0, np.int64), *map(unplaned, words.column("size").to_pylist())])
    offsets = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(words.column("groups").to_pylist()))])
    right = size[order] > 0
    groups, value = _spelled(coded.take(pa.array(order)))
    value |= {"n_best": column("n_best"), "count_sum": column("count_sum")}
    flat, ends = _sent(docs)
    sizes = np.diff(np.concatenate([[0], ends]))

    def totals(value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sizes), np.int64)
        some = sizes > 0
        if some.any():
            out[some] = np.add.reduceat(value[flat], (ends - sizes)[some], dtype=np.int64)
        return out

    good = (sizes > 0) & (totals(~right) == 0)
    found = {name: np.where(good, totals(v), 0) for name, v in value.items()}
    texts, part, held = [], [], 0
    for g, n, e in zip(good.tolist(), sizes.tolist(), ends.tolist(), strict=True):
        part.append(";".join(map(groups.__getitem__, flat[e - n : e].tolist())) if g else None)
        held += len(part[-1] or "")
        if held > PART:  # a table goes back in the batches that its columns have
            texts, part, held = [*texts, pa.array(part, pa.string())], [], 0
    texts = pa.chunked_array([*texts, pa.array(part, pa.string())], pa.string())
    return pa.table({"doc_id": docs.column("doc_id"), **found, "n_links": found["n_groups"], "groups": texts})


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_best, count_sum, n_links, groups`` of every
    row; ``groups`` is null for a document without tokens.

    Tokens are never empty, so the last two of each group are the only ones that
    end together: a document has as many links as groups. ``first``, ``second``:
    files of the tokenizers, the same on every executor.
    """
    kept = Tables(docs.sparkSession)
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(first, second), "block long, doc_id long, segments binary, words array<string>, times array<long>")
    coded = kept.keep(coded)
    rows = coded.where("segments is not null").select("block", "doc_id", "segments")
    each = coded.where("words is not null").select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("words", "times")).alias("number", "w"))
    words = each.select("home", "number", F.col("w.words").alias("segment"), F.col("w.times").alias("times"))
    once = words.groupBy("segment").agg(F.sum("times").alias("times"))
    known = once.mapInArrow(_aligned(first, second), "segment string, times long, groups binary, links array<long>")
    # From here on a number stands for a segment, except where it meets the blocks.
    known = kept.keep(known.select(F.monotonically_increasing_id().alias("id"), "*"))

    counted = known
    wrong = known.where("groups is null").select("segment")
    if not wrong.isEmpty():  # documents with such a segment have no tokens, so their others count less often
        at = words.join(wrong, "segment").select("home", "number")
        left_out = rows.groupBy("block").cogroup(at.groupBy("home")).applyInArrow(_left_out, "home long, number int, n long")
        less = words.join(left_out, ["home", "number"]).groupBy("segment").agg(F.sum("n").alias("less"))
        counted = known.join(less, "segment", "left").withColumn("times", F.col("times") - F.coalesce("less", F.lit(0)))
    linked = counted.where("groups is not null and times > 0").select(F.explode("links").alias("pair"), "times")
    pairs = kept.keep(linked.groupBy("pair").agg(F.sum("times").alias("n")))
    kept.drop()

    second_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("second")
    highest = pairs.groupBy(second_id).agg(F.max("n").alias("highest"))
    rated = pairs.withColumn("second", second_id).join(highest, "second").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    # A pair that a large share of the segments has is dealt out by copies of its count.
    rated = rated.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = known.select("id", F.explode("links").alias("pair")).withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(COPIES)).cast("int"))
    sums = dealt.join(rated, ["pair", "copy"]).groupBy("id").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    full = kept.keep(known.select("id", "segment", "groups").join(sums, "id", "left").drop("id").fillna(0, ["count_sum", "n_best"]))
    kept.drop(known, pairs)
    joined = words.drop("times").join(full, "segment").select("home", "number", "groups", "n_best", "count_sum")
    joined = joined.mapInArrow(gathered, "home long, number binary, size binary, n_best binary, count_sum binary, groups binary")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, n_links long, groups string"
    return rows.groupBy("block").cogroup(joined.groupBy("home")).applyInArrow(_composed, out)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), default_model())
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
