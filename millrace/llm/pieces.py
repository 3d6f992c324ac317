"""SentencePiece encoding with the bytes of the original under every piece.

A model's normaliser replaces, at each place, the longest prefix that its
compiled character map knows, puts a word mark for spaces and may drop
repeated ones. Here that is done beside an alignment that holds, for every
byte of the normalised text, the byte of the original it came from, so a
piece's place in the normalised text projects to a span of original bytes.
Every text takes that way, a slice of them at a time: the trie is asked only at
bytes with which a known prefix can begin (none, if the map is empty), and what
lies between is carried over by array operations. Models that squeeze spaces,
put the mark behind the text or have pieces of the user's own go character by
character.

In BPE no piece continues over the start of a word mark, so a normalised text
falls into chunks (marks, then what follows) that are segmented one by one;
chunks repeat, hence each task keeps those it has seen. Models for which this
does not hold (a piece with an inner mark, unigram models) get whole texts.
Segmenting a chunk is left to the library, told not to normalise again.

Edge cases: a null text reads as empty and gives no pieces; bytes that are not
UTF-8 read as U+FFFD each, and spans count these; texts of any
length are encoded whole, a task holds one slice of about 256 KB (or one longer
text) at a time; equal rows give equal results; an empty table gives an empty
result; other columns are dropped except the id.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

MARK = "▁"
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))
#: Bytes of text that a task encodes in one go, and chunks that it remembers.
SLICE, REMEMBERED, LONGEST = 1 << 18, 100_000, 80


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        value, shift, i = value | (byte & 127) << shift, shift + 7, i + 1
        if byte < 128:
            return value, i


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a serialised message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        if tag & 7 == 0:
            value, i = _varint(data, i)
        else:
            size, i = _varint(data, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 bytes, then
    the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if size else []
        self.texts = blob[4 + size :]

    def begins(self, byte: int) -> bool:
        """Whether a known prefix may begin with that first byte of a character."""
        if not self.units:
            return False
        node = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length in bytes and replacement of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        unit, found = self.units[0], None
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])].decode()


class Normalizer:
    """Normalised text and alignment, as the model at ``path`` asks for."""

    def __init__(self, path: str):
        self.model = open(path, "rb").read()
        self.pieces: list[tuple[str, int]] = []
        spec = {3: 1, 4: 1, 5: 1}
        trainer: dict = {}
        for number, value in fields(self.model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), piece.get(3, 1)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec[3]), bool(spec[4]), bool(spec[5])
        self.suffix, self.bpe = bool(trainer.get(24, 0)), trainer.get(3, 1) == 2
        own = sorted((p for p, kind in self.pieces if kind == 4), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        #: What a byte becomes does not depend on what came before it.
        self.local = not self.squeeze and not self.suffix and not own
        self.first = np.zeros(256, dtype=bool)
        self.first[[b for b in range(256) if b >> 6 != 2 and self.map.begins(b)]] = True
        #: Chunks may be segmented apart.
        self.apart = self.bpe and not own and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in self.pieces)

    def segmenter(self):
        """The library with the same pieces and no normalisation: a later
        normaliser message overrides fields of the first."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model + b"\x1a\x06\x12\x00\x18\x00\x20\x00")

    def _prefix(self, text: str, data: bytes, char: int, byte: int) -> tuple[str, int, int]:
        """Replacement of the longest prefix, with its length in characters and bytes."""
        if self.own and (m := self.own.match(text, char)):
            return m.group(), len(m.group()), len(m.group().encode())
        if found := self.map.longest(data, byte):
            return found[1], len(data[byte : byte + found[0]].decode()), found[0]
        return text[char], 1, len(text[char].encode())

    def align(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the
        byte of the original."""
        data, out, at = text.encode(), [], []
        char = byte = 0
        mark = MARK if self.escape else " "
        if self.squeeze:
            while char < len(text) and (p := self._prefix(text, data, char, byte))[0] == " ":
                char, byte = char + p[1], byte + p[2]
        if char == len(text):
            return "", np.zeros(1, dtype=np.int64)

        def put(piece: str, start: int) -> None:
            for c in piece:
                c = mark if c == " " else c
                out.append(c)
                at.extend([start] * len(c.encode()))

        if self.prefix and not self.suffix:
            put(" ", byte)
        space = self.squeeze
        while char < len(text):
            piece, chars, size = self._prefix(text, data, char, byte)
            if space:
                piece = piece.lstrip(" ")
            if piece:
                put(piece, byte)
                space = self.squeeze and piece.endswith(" ")
            char, byte = char + chars, byte + size
        if self.squeeze:
            while out and out[-1] == mark:
                out.pop()
                byte = at[-len(mark.encode())]
                del at[-len(mark.encode()) :]
        if self.prefix and self.suffix:
            put(" ", byte)
        return "".join(out), np.array([*at, byte], dtype=np.int64)


    def align_all(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of many texts: the normalised bytes, where each text's begin (and
        the last ends) among them, for each byte and the end the byte of the
        original, where each original begins, and how far into each what is
        left of it reaches."""
        data = b"".join(texts)
        origin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        mark = np.frombuffer((MARK if self.escape else " ").encode(), np.uint8)
        if not self.local:
            both = [self.align(t.decode()) for t in texts]
            whole = [n.encode() for n, _ in both]
            bounds = np.concatenate([[0], np.cumsum([len(n) for n in whole])]).astype(np.int64)
            return b"".join(whole), bounds, np.concatenate([*(a[:-1] + o for (_, a), o in zip(both, origin, strict=False)), origin[-1:]]), origin, np.array([a[-1] for _, a in both], np.int64)
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        width, put, end = np.where(space, len(mark), 1), [], 0
        starts = set(origin.tolist()) if self.map.units else set()
        for i in np.flatnonzero(self.first[raw]).tolist():
            # Prefixes do not reach over the end of their text.
            if i >= end and (found := self.map.longest(data[: origin[np.searchsorted(origin, i, side="right")]] if starts else data, i)):
                end = i + found[0]
                piece = found[1].replace(" ", mark.tobytes().decode()).encode()
                width[i], width[i + 1 : end], space[i:end] = len(piece), 0, False
                put.append((i, piece))
        head = origin[:-1][np.diff(origin) > 0] if self.prefix else np.zeros(0, np.int64)
        width[head] += len(mark)
        at = np.repeat(np.arange(len(raw)), width)
        before = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        out, own = raw[at], before[:-1].copy()
        own[head] += len(mark)
        for k in range(len(mark)):
            out[own[space] + k] = mark[k]
            out[before[head] + k] = mark[k]
        for i, piece in put:
            out[own[i] : own[i] + len(piece)] = np.frombuffer(piece, np.uint8)
        return out.tobytes(), before[origin], np.concatenate([at, [len(raw)]]), origin, np.diff(origin)


class Encoder:
    """Pieces of many texts at once, with a memory of chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.norm = Normalizer(path)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.lib = self.norm.segmenter()
        # Decoding drops the space of the model's own prefix, so it needs the model as it is.
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=self.norm.model)
        byte = {i for i, (_, kind) in enumerate(self.norm.pieces) if kind == 6}
        self.size = np.array([1 if i in byte else len(p.encode()) for i, (p, _) in enumerate(self.norm.pieces)], dtype=np.int64)
        self.unknown = self.lib.unk_id()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.flat, self.lens = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _learn(self, chunks: list[str]) -> None:
        ids = self.lib.encode(chunks, num_threads=1)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for row in ids for x in row), dtype=np.int32, count=int(counts.sum()))
        lens = self.size[flat]
        if (flat == self.unknown).any():  # how long an unknown piece is only the library knows
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for i in np.unique(np.searchsorted(bounds, np.flatnonzero(flat == self.unknown), side="right") - 1):
                lens[bounds[i] : bounds[i + 1]] = [len(p.surface.encode()) for p in self.lib.encode(chunks[i], return_type="proto").pieces]
        self.known.update(zip(chunks, range(len(self.start) - 1, len(self.start) - 1 + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of all pieces and the texts' bounds among them."""
        whole, begin, origin_of, origin, stop = self.norm.align_all([t.encode() for t in texts])
        normal = [whole[a:b].decode() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        parts = [self.split(n) if self.norm.apart else [n] if n else [] for n in normal]
        chunks = [c for p in parts for c in p]
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [c for c in dict.fromkeys(chunks) if c not in self.known]:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        counts = self.start[at + 1] - self.start[at]
        before = np.concatenate([[0], np.cumsum(counts)])
        gather = np.repeat(self.start[at] - before[:-1], counts) + np.arange(before[-1])
        ids, lens = self.flat[gather], self.lens[gather].astype(np.int64)
        bounds = before[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
        for c in new:
            if len(c) > LONGEST:
                del self.known[c]
        # Pieces cover their normalised text without gaps: their lengths place them there, the alignment in the original.
        place = np.concatenate([[0], np.cumsum(lens)])
        shift = np.repeat(begin[:-1] - place[bounds[:-1]], np.diff(bounds))
        text_at = np.repeat(origin[:-1], np.diff(bounds))
        starts, ends = origin_of[place[:-1] + shift] - text_at, origin_of[place[1:] + shift] - text_at
        some = np.diff(bounds) > 0
        ends[bounds[1:][some] - 1] = stop[some]
        return ids, starts, ends, bounds


_encoders: dict[str, Encoder] = {}


def _rows(path: str, decoded: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            column = batch.column(1).fill_null("")
            sizes = np.cumsum(np.frombuffer(pa.compute.binary_length(column).cast(pa.int64()).buffers()[1], dtype=np.int64)[: len(column)])
            i = 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")))
                raw = column.slice(i, j - i).cast(pa.binary()).to_pylist()
                ids, starts, ends, bounds = encoder.encode([x.decode("utf-8", "each_byte") for x in raw])
                at = pa.array(bounds, pa.int32())
                made = {x: pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for x, v in (("ids", ids), ("starts", starts.astype(np.int32)), ("ends", ends.astype(np.int32)))}
                if decoded:
                    flat = ids.tolist()
                    back = encoder.whole.decode([flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], num_threads=1)
                    made["decoded"] = pa.array(back, pa.string())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i)} | made)
                i = j

    return run


def encode(docs: DataFrame, model: str, decoded: bool = True) -> DataFrame:
    """``doc_id, ids, starts, ends, decoded`` of every row of ``docs``: the
    pieces' ids, the byte spans of the original text that they cover, and the
    text that the library decodes from the ids (unless ``decoded`` is false).

    ``model``: the model file's path, the same on every executor.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(model, decoded), "doc_id long, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decoded)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("covered_bytes"),
    )


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), default_model()))
