"""Fill-in-the-middle, alignment of two tokenizers, numbers of tokens."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, fim, pieces, token_counts

JSON, MODEL, WORDS = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = ["a", "don't", "'s", "'", "'re", "'ll", "'v", " ", "  ", "\n", "\t", " \n", "\n ", "é", "日本", "1", "²", "!", "?!", "<|endoftext|>", "\x1c", "\x85", " ", "'m'", "é", "😀", "x" * 20, "Ⅳ", "　", "\x00", "▁", "<s>", "<0x41>", "unbelievable", "<P>", "ok.\n\n"]


def made(n: int, seed: int = 0, parts=PARTS) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def frame(spark, texts, more=True):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, None), (3, "an id twice"), (3, "an id twice"), (9000, ""), (9001, "long words " * 30000 + "x" * 3000)] * more
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long"), rows


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle(spark):
    df, rows = frame(spark, made(400, 1))
    out = fim.transform(df).select("*", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("back")).collect()
    want = sorted((str(i), *map(str, plain_fim(i, t)), t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["n"]), r["form"], str(r["prefix_units"]), str(r["middle_units"]), r["output"], r["back"]) for r in out) == want
    assert {r["form"] for r in out} == set(fim.FORMS)
    assert fim.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit, texts", [("char", ["é日a", "", "😀"]), ("word", ["  one two\nthree ", "", "x"]), ("line", ["a\n\nb", "\n", ""])])
def test_units(unit, texts):
    """Every number of units cuts where counting one by one says."""
    import re

    parts = {"char": lambda t: list(t), "word": lambda t: re.findall(r"^\s+\S*\s*|\S+\s*", t), "line": lambda t: t.splitlines(keepends=True)}[unit]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for k in range(6):
        n, low, high, at, to = fim.cuts(data, bounds, np.full(len(texts), k), np.full(len(texts), 5), unit)
        for i, t in enumerate(texts):
            own = parts(t)
            if unit == "word" and t.startswith(" "):
                own = ["  ", *parts(t.lstrip())]  # white space before the first word is a unit
            assert n[i] == len(own) and low[i] == min(k % (n[i] + 1), 5 % (n[i] + 1))
            assert at[i] - bounds[i] == len("".join(own[: low[i]]).encode()) and to[i] - bounds[i] == len("".join(own[: high[i]]).encode())


def test_fill_in_middle_of_odd_bytes(spark):
    df = spark.sql("select id as doc_id, cast(x as string) as text from values (1, X'80c3'), (2, X'41ff80'), (5, X'e697'), (8, X'') as t(id, x)")
    for r in fim.transform(df, percent=100).select("output", fim.restored(fim.F.col("output"), fim.F.col("form")).cast("binary").alias("back"), "doc_id").collect():
        assert bytes(r["back"]) == {1: b"\x80\xc3", 2: b"A\xff\x80", 5: b"\xe6\x97", 8: b""}[r["doc_id"]]


def test_fill_in_middle_sql(spark, sf):
    got = fim.op11_fill_in_middle(spark, sf)
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = db.sql(fim.ORACLE)
    assert set(want.columns) == set(got.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def lib(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
def test_token_counts(spark, path):
    df, rows = frame(spark, made(600, 2))
    if path == MODEL:
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for _, t in rows])]
    else:
        want = [len(e.ids) for e in lib(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    got = token_counts.counts(df, path).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(rows, want, strict=True))
    assert token_counts.counts(df.limit(0), path).count() == 0


def test_tiers_do_not_change_counts():
    """With any table, and with a memory that is full all the time, the numbers are the library's."""
    texts = made(3000, 3)
    want = [len(e.ids) for e in lib(JSON).encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.Counter(JSON)
    s = token_counts.Slice(counter.cutter, texts)
    keys = np.unique(np.stack([s.low, s.high], axis=1), axis=0)
    old, token_counts.REMEMBERED = token_counts.REMEMBERED, 10
    try:
        for part in (keys[::2], keys[:1], keys):
            words = [token_counts.text_of(*k) for k in part.tolist()]
            assert all(w.encode() == w.encode()[:15] for w in words)
            tier = token_counts.Table(part[:, 0], part[:, 1], np.array(counter.lengths(words), np.int32))
            assert (tier.find(part[:, 0], part[:, 1]) > 0).all()
            assert [n for i in range(0, 3000, 250) for n in counter.count(texts[i : i + 250], tier)] == want
    finally:
        token_counts.REMEMBERED = old


def test_frequent_pre_tokens(spark):
    """Tasks count for themselves; what is frequent in the corpus is in the table."""
    texts = [f" the quick{i} fox" for i in range(3000)]
    df, _ = frame(spark, texts, False)
    counter, tier = token_counts.Counter(JSON), token_counts.frequent(df.repartition(3), JSON)
    s = token_counts.Slice(counter.cutter, [" the", " fox", " quick"])
    assert (tier.find(s.low, s.high) > 0).all() and len(tier.low) <= 4 * token_counts.FREQUENT


def plain_alignment(texts):
    """Token by token, whole texts."""
    a_lib = lib(JSON)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    value = token_counts.byte_values()
    found, count = [], Counter()
    for t in texts:
        t = t or ""
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_bytes = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            found.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        a_end, b_end = ends(a_bytes), ends(b_bytes)
        cuts = sorted(set(a_end) & set(b_end))
        groups, links = [], [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if a_end[i] == b_end[j]]
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(x) for x, e in zip(a, a_end, strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, b_end, strict=True) if lo < e <= hi))
        count.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(f[0], f[1], f[2], len(f[3]), sum(count[p] == highest[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, None) for f in found]


@pytest.mark.parametrize("block", [alignment.BLOCK, 500])
def test_alignment(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    df, rows = frame(spark, made(250, 5) + ["plain words, as they come.", " two  spaces", "tail \n"], False)
    rows += [(None, "no id"), (3, None), (3, "an id twice"), (3, "an id twice"), (9000, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    want = sorted((str(i), *map(str, w)) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in names)) for r in alignment.align(df, JSON, MODEL).collect()) == want
    assert sum(w[2] != "0" for w in want) > 100
    assert alignment.align(df.limit(0), JSON, MODEL).count() == 0


def test_alignment_of_odd_bytes(spark):
    df = spark.sql("select id as doc_id, cast(x as string) as text from values (1, X'41ff'), (2, X'41') as t(id, x)")
    assert sorted((r["doc_id"], r["n_groups"]) for r in alignment.align(df, JSON, MODEL).collect()) == [(1, 0), (2, 1)]


def test_alignment_of_nothing(spark):
    """Blocks without a segment."""
    df = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_a"], r["n_links"], r["count_sum"], r["groups"]) for r in alignment.align(df, JSON, MODEL).collect()) == [("1", 0, 0, 0, None), ("2", 0, 0, 0, None), ("None", 0, 0, 0, None)]


def test_alignments_move_as_bytes():
    """Two or three bytes an id and its sign, and the same text and counts again."""
    pair = alignment.Pair(JSON, MODEL)
    groups, _, at = pair.align([" tokenisation", " the", " of it"])
    texts, n = alignment._spelled(pa.array([*groups, None], pa.binary()))
    assert texts[3] == "" and n["n_groups"].tolist() == [*(at[1:] - at[:-1]).tolist(), 0]
    for data, text, a, b in zip(groups, texts, n["n_a"].tolist(), n["n_b"].tolist(), strict=False):
        sides = [g.split("|") for g in text.split(";")]
        assert len(data) <= 3 * (a + b) and (a, b) == tuple(sum(len(g[i].split(",")) for g in sides) for i in (0, 1))


def test_alignments_are_gathered_by_block():
    """A row a block, with everything in it, whatever the batches."""
    rows = [(i % 3, i // 3, bytes([i]) if i % 4 else None, i, i << 40) for i in range(30)]
    cells = pa.RecordBatch.from_pylist([dict(zip(("home", "number", "groups", "n_best", "count_sum"), r, strict=True)) for r in rows])
    (found,) = alignment.gathered(iter([cells.slice(0, 7), cells.slice(7)]))
    assert found["home"].to_pylist() == [0, 1, 2]
    back = []
    for r in found.to_pylist():
        data = iter(r["groups"])
        for number, size, best, total in zip(alignment.unplaned(r["number"]).cumsum().tolist(), *(alignment.unplaned(r[c]).tolist() for c in ("size", "n_best", "count_sum")), strict=True):
            back.append((r["home"], number, bytes(next(data) for _ in range(size - 1)) if size else None, best, total))
    assert sorted(back, key=lambda r: r[3]) == rows


def test_packed_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 5])
    assert alignment.unpacked(alignment.packed(x)).tolist() == x.tolist() and len(alignment.packed(x[:3])) == 3
    assert len(alignment.unpacked(alignment.packed(x[:0]))) == 0


def test_breaks():
    """Splits need what the vocabularies show; without them texts stay whole, and segments join up to them."""
    pair = alignment.Pair(JSON, MODEL)
    assert pair.breaks == " \t\n\x0b\x0c"  # the second has ";\r" and the like
    split = pair.splitter()
    for t in made(500, 7):
        assert "".join(split(" " + t)) == " " + t
    assert split(" a  b\n\nc d e ") == [" a", "  b", "\n\nc d", " e", " "]
    spaced = alignment.Pair(WORDS, MODEL)
    assert spaced.breaks == "" and spaced.splitter()(" a b") == [" a b"]


def test_pieces_without_decoded_text(spark):
    """The same pieces; nothing is decoded for those who do not ask for it."""
    docs = spark.createDataFrame([(1, "a b  c"), (2, None), (3, ""), (4, "x\u00e9 " * 50)], "doc_id long, text string")
    whole, short = (pieces.encode(docs, pieces.default_model(), d) for d in (True, False))
    assert short.columns == ["doc_id", "ids", "starts", "ends"]
    assert sorted(short.collect()) == sorted(whole.drop("decoded").collect())
