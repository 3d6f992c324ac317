"""Fill-in-the-middle: texts cut in three and put together again in another order.

Where to cut is found for all rows of a slice at once, on the bytes of the
Arrow buffer: a table gives the class of every byte, a small matrix says
whether a unit begins between two neighbouring classes, the running count of
begun units (taken from each document's own start) numbers them, and one
``searchsorted`` over that count finds the bytes at which all rows are cut.
Units are characters, words (with the white space behind them) or lines.

The numbers that decide form and cuts come from a digest of the id, so reruns
and lost executors give the same rows.

Edge cases: a null text reads as empty, an empty text stays plain, as does one
that holds a marker; a row without id is dealt by the digest of an empty id;
rows with one id are cut by the same numbers; bytes that are not UTF-8 pass
unchanged (a continuation byte belongs to the unit before it, a text's first
byte always begins one); a task holds one slice of about 2 MB, or one longer
text, with some eight times its bytes; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Bytes of text that are cut in one go.
SLICE = 1 << 21


def _units(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The class (0 or 1) of each byte, and whether a unit begins between
    a byte of class i and a following one of class j."""
    byte = np.arange(256)
    if unit == "char":  # class 1 continues a character
        return (byte >> 6 == 2).astype(np.uint8), np.array([[True, False], [True, False]])
    if unit == "word":  # class 1 is white space
        return ((byte == 32) | (byte >= 9) & (byte <= 13)).astype(np.uint8), np.array([[False, False], [True, False]])
    if unit == "line":  # class 1 ends a line
        return (byte == 10).astype(np.uint8), np.array([[False, False], [True, True]])
    raise ValueError(f"unit is char, word or line, not {unit}")


def cuts(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each text, the smaller and the larger of
    ``first % (n + 1)`` and ``second % (n + 1)``, and the bytes at which so many units end.

    ``data``: the bytes of all texts; ``bounds``: where each begins, and the end.
    """
    classes, pair = _units(unit)
    of = classes[data]
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = pair.ravel()[of[:-1] * 2 + of[1:]]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    count = np.cumsum(begins, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    before = np.concatenate([[0], count])[bounds]
    n = np.diff(before)
    one, two = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # Unit number k of a text begins at the first byte by which k + 1 units have begun.
    find = lambda k: np.searchsorted(count, before[:-1] + k + 1)
    return n, low, high, np.minimum(find(low), bounds[1:]), np.minimum(find(high), bounds[1:])


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(column)).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")))
        yield i, j
        i = j


def _rows(unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            form, first, second = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 3, 4))
            for i, j in _slices(texts):
                part = texts.slice(i, j - i)
                buffers = part.buffers()
                bounds = np.frombuffer(buffers[1], np.int32)[part.offset : part.offset + j - i + 1].astype(np.int64)
                data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
                bounds -= bounds[0]
                n, low, high, at, to = cuts(data, bounds, first[i:j], second[i:j], unit)
                out, sizes = [], []
                for f, a, b, c, d in zip(form[i:j].tolist(), bounds[:-1].tolist(), at.tolist(), to.tolist(), bounds[1:].tolist(), strict=True):
                    if f == 0:
                        own = [data[a:d]]
                    elif f == 1:
                        own = [marks[0], data[a:b], marks[1], data[c:d], marks[2], data[b:c]]
                    else:
                        own = [marks[1], data[c:d], marks[0], data[a:b], marks[2], data[b:c]]
                    out += own
                    sizes.append(sum(map(len, own)))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                made = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends), pa.py_buffer(np.concatenate(out)))
                plain = form[i:j] == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(form[i:j].astype(np.int32)),
                     pa.array(low.astype(np.int64), mask=plain), pa.array((high - low).astype(np.int64), mask=plain), made],
                    names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"],
                )

    return run


def _digest_number(k: int, seed: int) -> Column:
    """The k-th group of eight hexadecimal digits of the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, percent: int = 90, spm_percent: int = 20, unit: str = "char", seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` of every row.

    ``percent`` of the texts are cut, of those ``spm_percent`` put the suffix
    first; the rest stay plain.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = (text == "") | (_digest_number(2, seed) % 100 >= percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        kept |= F.contains(text, F.lit(mark))
    form = F.when(kept, 0).when(_digest_number(3, seed) % 100 < spm_percent, 2).otherwise(1)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), _digest_number(0, seed).alias("first"), _digest_number(1, seed).alias("second"))
    out = dealt.mapInArrow(_rows(unit), "doc_id long, n long, form int, prefix_units long, middle_units long, output string")
    return out.withColumn("form", F.element_at(F.array(*map(F.lit, FORMS)), F.col("form") + 1))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from what it made of it; counted
    in bytes, as texts that are not UTF-8 have no certain characters."""
    after = lambda s, n: F.substr(s.cast("binary"), n + 1, F.lit(2**31 - 1)).cast("string")
    before = lambda s, mark: F.substring_index(s, mark, 1)
    rest = lambda s, mark: after(s, F.octet_length(before(s, mark)) + len(mark))
    body = after(output, F.lit(len(PREFIX)))  # without its first marker
    psm = F.concat(before(body, SUFFIX), rest(body, MIDDLE), before(rest(body, SUFFIX), MIDDLE))
    spm = F.concat(before(rest(body, PREFIX), MIDDLE), rest(body, MIDDLE), before(body, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h, length(coalesce(text, '')) as n from documents
), h as (
  select *, cast('0x' || substring(h, 1, 8) as bigint) as h1, cast('0x' || substring(h, 9, 8) as bigint) as h2, cast('0x' || substring(h, 17, 8) as bigint) as h3, cast('0x' || substring(h, 25, 8) as bigint) as h4 from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text
    when 'psm' then '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
    else '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) end) as output_sha256,
  sha256(text) as restored_sha256
from f
"""
