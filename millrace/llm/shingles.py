"""Sets of hashed five-word shingles, a whole Arrow batch at a time.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
Eight bytes of a word at a time are folded into its hash, each time followed by
a full mix (words of up to eight bytes cannot collide, longer ones as seldom as
random numbers of 64 bits); words over ``LONG`` bytes are hashed by BLAKE2. A
shingle's hash comes from those of its five words. Two such hashes with other
constants make the 128 bits that stand for a set as a whole; its members alone
are 64 bits wide, which only pairs that are compared member by member rely on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed in one go; a longer text is a go of its own.
CHUNK = 1 << 21
WIDTH = 5
#: Bytes of a word that are hashed eight at a time.
LONG = 64
#: Constants of the two hashes.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts ``data[offsets[i]:offsets[i + 1]]``
    and the number of words before each text (and, last, in all)."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]]) & ~first[:-1]
    after = np.concatenate([word[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``, lower-cased."""
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=low, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = _mixed(size.astype(np.uint64) * np.uint64(seed) + np.uint64(seed >> 7))
    at = np.flatnonzero(size <= LONG)
    for j in range(0, LONG, 8):
        at = at[size[at] > j]
        if not len(at):
            break
        out[at] = _mixed((out[at] ^ (eight[starts[at] + j] & _FIRST[np.minimum(size[at] - j, 8)])) + np.uint64(seed))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def _runs(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every ``width`` neighbouring words."""
    place = _mixed(np.arange(11, 11 + width, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    return _mixed(sum((hashes[j : n + j] * place[j] for j in range(width)), np.full(n, width, np.uint64)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, twice: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its distinct shingle hashes, ascending, and if wanted
    their second hashes in the same order."""
    starts, ends, bounds = words(data, offsets)
    seeds = SEEDS if twice else SEEDS[:1]
    hashes = [word_hashes(data, starts, ends, s) for s in seeds]
    runs = [_runs(h, WIDTH, s) for h, s in zip(hashes, seeds, strict=True)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            own = [r[a : b - WIDTH + 1] for r in runs]
        else:
            own = [_runs(h[a:b], b - a, s) if b > a else h[:0] for h, s in zip(hashes, seeds, strict=True)]
        if twice:
            order = np.argsort(own[0], kind="stable")
            found, second = own[0][order], own[1][order]
        else:
            found, second = np.sort(own[0]), None
        new = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
        yield found[new], second[new] if twice else None


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from, to, bytes, offsets) of a string column, about CHUNK bytes each; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _halves(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets], dtype=np.int64)


def set_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (doc_id, mark, text): doc_id, mark, the two
    halves of the set's key, one of each hash, and its size."""
    for batch in batches:
        for i, j, data, offsets in texts(batch.column(2)):
            found = list(shingle_sets(data, offsets, twice=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(_halves([x for x, _ in found])), pa.array(_halves([x for _, x in found])), pa.array([len(x) for x, _ in found], pa.int64())],
                names=["doc_id", "mark", "half", "rest", "n"],
            )


KEY_SCHEMA = "doc_id long, mark long, half long, rest long, n long"


def set_members(eighths: int):
    """For ``mapInArrow`` over (text): the halves of the set's key and those of
    its members that lie in the first eighths of all hashes; of a part of the
    members, the second half is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts(batch.column(0)):
                found = list(shingle_sets(data, offsets, twice=eighths == 8))
                whole = [x for x, _ in found]
                rest = pa.array(_halves([x for _, x in found])) if eighths == 8 else pa.nulls(len(found), pa.int64())
                kept = whole if eighths == 8 else [x[: np.searchsorted(x, np.uint64(eighths << 61))] for x in whole]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in kept])])
                members = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(kept).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_halves(whole)), rest, members], names=["half", "rest", "members"])

    return run


MEMBER_SCHEMA = "half long, rest long, members array<long>"
