"""The whole way from a table to features: clean, infer, impute, make, select.

Fitting is planned as few jobs: one that profiles all columns, one for all
global statistics together, one per encoded column, one for the selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import base, categorical, cleaning, numeric, profiling, selection, temporal, text


class AutoFeatures:
    def __init__(self, target: str | None = None, most: int | None = None, encoding: str = "auto", interactions: int = 10, correlation: float | None = 0.95):
        self.target, self.most, self.encoding, self.interactions, self.correlation = target, most, encoding, interactions, correlation
        self.steps: base.Pipeline | None = None
        self.types: dict[str, str] = {}

    def plan(self, df: DataFrame) -> base.Pipeline:
        self.types = profiling.infer_types(df)
        own = {k: [c for c, t in self.types.items() if t == k and c != self.target] for k in ("numeric", "categorical", "datetime", "text")}
        nums = [c for c in own["numeric"] if c in base.numeric_columns(df)]
        cats = [c for c in own["categorical"] if c in base.string_columns(df)]
        steps: list = [("impute", cleaning.Impute([*nums, *cats], indicator=True))]
        made = [numeric.Log(nums), numeric.Power(nums, ("sqrt",)), numeric.Interactions(nums, most=self.interactions)]
        if times := [c for c in own["datetime"] if c in base.time_columns(df)]:
            made.append(temporal.DateParts(times))
        if own["text"]:
            made.append(text.TextBasic(own["text"]))
        steps.append(("make", base.Union(made)))
        if cats:
            encode = self.encoding
            if encode == "auto":
                encode = "target" if self.target else "frequency"
            kinds = {"target": categorical.Target, "frequency": categorical.Frequency, "onehot": categorical.OneHot, "ordinal": categorical.Ordinal, "woe": categorical.WeightOfEvidence}
            steps.append(("encode", kinds[encode](cats)))
        if self.correlation:
            steps.append(("decorrelate", Late(lambda cols: selection.Correlation(cols, self.correlation), nums, self.target)))
        if self.most and self.target:
            steps.append(("select", Late(lambda cols: selection.Statistical(cols, "f_regression", k=self.most), nums, self.target)))
        return base.Pipeline(steps)

    def fit(self, df: DataFrame, target: str | None = None) -> AutoFeatures:
        self.target = target or self.target
        df = base.clean_frame(df)
        self.steps = self.plan(df).fit(df, self.target)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.steps.transform(base.clean_frame(df))

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)


class Late(base.Operator):
    """A selector over the numeric columns that earlier steps made."""

    def __init__(self, make, originals: list[str], target: str | None):
        super().__init__([])
        self.make, self.originals, self.target = make, originals, target

    def fit(self, df: DataFrame, target: str | None = None) -> Late:
        made = [c for c in base.numeric_columns(df) if c != self.target and c not in self.originals]
        self.state, self.selector = {}, self.make(made).fit(df, self.target)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.selector.transform(df)
