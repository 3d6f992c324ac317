"""Costly parts of a row's features are worked out once, however many columns need them."""

from pyspark.sql import functions as F

from millrace.operators import categorical, profiling, selection, text


def test_one_digest_for_all_buckets(spark, capsys):
    df = spark.range(20).select(F.concat(F.lit("k"), "id").alias("k"))
    categorical.Hashing(["k"]).fit_transform(df).explain("codegen")
    assert 1 <= capsys.readouterr().out.count("md5Hex") <= 4


def test_terms_of_a_text_are_cut_once(spark):
    df = spark.createDataFrame([("a b a",), ("b c",), (None,), ("c a",)], "text string")
    out = text.TermCounts(["text"], least_df=1).fit(df).transform(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = sorted((r["text"] or "", r["text_count_a"], r["text_count_b"], r["text_count_c"]) for r in out.collect())
    assert got == [("", 0, 0, 0), ("a b a", 2, 1, 0), ("b c", 0, 1, 1), ("c a", 1, 0, 1)]


def test_types_that_say_what_they_are_are_not_parsed(spark, monkeypatch):
    asked, run = {}, profiling.run_aggregates
    monkeypatch.setattr(profiling, "run_aggregates", lambda df, wanted: run(df, asked.setdefault("w", wanted)))
    df = spark.sql("select id, id % 2 as bit, cast(id % 2 as double) as x, if(id = 3, null, id % 2 * 5) as five, date'2024-01-01' + cast(id as int) as day, id > 2 as more, cast(null as int) as none, cast(id as string) as digits, if(id > 2, 'Yes', 'no') as said from range(9)")
    want = {"id": "numeric", "bit": "boolean", "x": "numeric", "five": "numeric", "day": "datetime", "more": "boolean", "none": "unknown", "digits": "numeric", "said": "boolean"}
    assert profiling.infer_types(df) == want
    parsed = {k.partition("|")[0] for k in asked["w"] if k.endswith(("|time", "|num", "|words"))}
    assert parsed == {"digits", "said"}


def test_shapley_takes_a_partners_prediction_from_the_partner(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i)) for i in range(60)], "a double, b double, y double")
    plan = selection.Shapley(["a", "b"], rounds=2, trees=2).credits(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    # A vector and its prediction each: the row as it is, and one mixed row a round. The full plan shows no interpreted function.
    assert plan.count("AS _own_0") == 1 and plan.count("array(_c") + plan.count("array(_with") <= 3
    assert "zip_with" not in plan and "transform(" not in plan


def test_shapley_of_many_classes(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), "xyz"[i % 3]) for i in range(60)], "a double, b double, y string")
    few = selection.Shapley(["a", "b"], rounds=2, trees=2).fit(df, "y").scores
    monkeypatch.setattr(selection, "FEW_CLASSES", 2)
    many = selection.Shapley(["a", "b"], rounds=2, trees=2).fit(df, "y").scores
    assert all(abs(few[c] - many[c]) < 1e-12 for c in "ab") and few["a"] > 0
