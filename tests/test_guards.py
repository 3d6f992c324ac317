"""What is asked of columns, kinds of personal data by name, exports, shapes of windows."""

import pandas as pd
import pytest

from millrace.operators import base, selection, temporal, text
from millrace.sources import io


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, float(i % 7), f"c{i % 20}", "x", None if i == 3 else i % 2) for i in range(60)], "id long, v double, c string, one string, y int")


def test_guards(frame):
    assert base.require_numeric(frame) == ["id", "v", "y"] and base.require_numeric(frame, ["v"]) == ["v"]
    assert base.require_categorical(frame, most=20) == ["c", "one"] and base.require_categorical(frame, ["one"], 1) == ["one"]
    assert base.require_target(frame, "v") == "v" and base.require_target(frame, "y", True, nulls=True) == "y"
    for bad, kind in (
        (lambda: base.require_numeric(frame, ["c"]), TypeError), (lambda: base.require_numeric(frame.select("c")), base.MissingColumn), (lambda: base.require_categorical(frame, most=19), ValueError),
        (lambda: base.require_categorical(frame.select("v")), base.MissingColumn), (lambda: base.require_target(frame, "y"), ValueError), (lambda: base.require_target(frame, "one"), ValueError),
        (lambda: base.require_target(frame, "c", False), TypeError), (lambda: base.require_target(frame.limit(0), "v"), ValueError), (lambda: base.require_target(frame, "z"), base.MissingColumn),
    ):
        with pytest.raises(kind):
            bad()


def test_personal_by_name(spark):
    df = spark.createDataFrame([("a@b.cd", "Ann", "x", "5", "y")], "contact string, first_name string, `Birth Date` string, salary string, diagnosis string")
    assert {(r["column"], r["kind"]) for r in text.scan_personal(df)} == {("contact", "email"), ("first_name", "name"), ("Birth Date", "date_of_birth"), ("salary", "financial"), ("diagnosis", "medical")}


def test_exports(spark, frame, tmp_path):
    s = selection.Variance(["id", "v"]).fit(frame)
    io.export_importance(spark, s, str(tmp_path / "i.csv"))
    assert [r["name"] for r in io.read(spark, str(tmp_path / "i.csv")).orderBy("position").collect()] == sorted(s.scores, key=lambda c: -s.scores[c])
    lag = temporal.Lag(["v"], (1, 2), by=["c"], order=["id"])
    lag.fit_transform(frame)
    io.export_names(spark, lag, str(tmp_path / "n.json"))
    assert [r["name"] for r in io.read(spark, str(tmp_path / "n.json")).orderBy("position").collect()] == ["v_lag_1", "v_lag_2"]


def test_shapes(frame):
    got = temporal.Rolling(["v"], (9,), ("skew", "kurt"), by=["one"], order=["id"]).fit_transform(frame).toPandas().sort_values("id")
    v = got["v"]
    assert pd.testing.assert_series_equal(got["v_rolling_9_skew"], v.rolling(9, min_periods=3).skew(), check_names=False) is None
    assert pd.testing.assert_series_equal(got["v_rolling_9_kurt"], v.rolling(9, min_periods=4).kurt(), check_names=False) is None
