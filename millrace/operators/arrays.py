"""Features of array cells: signals, images, embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.base import Operator


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def moments(c: str, prefix: str) -> dict[str, Column]:
    """Mean, population deviation, extremes, root mean square of an array."""
    a, n = F.col(c), F.size(c)
    mean = _sum(a, lambda x: x) / n
    square = _sum(a, lambda x: x * x) / n
    crossings = F.size(F.filter(F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: (x >= 0) != (y >= 0)), lambda b: b))
    made = {"mean": mean, "std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), "min": F.array_min(a).cast("double"), "max": F.array_max(a).cast("double"), "rms": F.sqrt(square), "max_abs": F.array_max(F.transform(a, F.abs)).cast("double"), "zero_crossings": crossings}
    return {f"{prefix}_{c}_{k}": F.when(n > 0, v) for k, v in made.items()}


class Signal(Operator):
    """Moments natively; peak, entropy and centroid of the spectrum by batch."""

    def __init__(self, columns, spectral=True, prefix="sig"):
        super().__init__(columns)
        self.spectral, self.prefix = spectral, prefix

    def expressions(self, df):
        out = {}
        for c in self.columns:
            out |= moments(c, self.prefix)
        return out

    def transform(self, df):
        out = super().transform(df)
        if self.spectral:

            @F.pandas_udf("struct<peak:double,entropy:double,centroid:double>")
            def spectrum(s: pd.Series) -> pd.DataFrame:
                """Arrays of one length are transformed together."""
                out = pd.DataFrame(np.nan, index=range(len(s)), columns=["peak", "entropy", "centroid"], dtype=float).astype(object).where(lambda d: d.notna(), None)
                sizes = np.array([0 if x is None else len(x) for x in s])
                for n in np.unique(sizes[sizes > 0]).tolist():
                    at = np.flatnonzero(sizes == n)
                    power = np.abs(np.fft.rfft(np.stack([np.asarray(x, dtype=float) for x in s.iloc[at]]), axis=1)) ** 2
                    freq, total = np.fft.rfftfreq(n), power.sum(axis=1, keepdims=True)
                    p = power / np.where(total > 0, total, 1.0)
                    out.iloc[at, 0] = freq[power[:, 1:].argmax(axis=1) + 1] if power.shape[1] > 1 else 0.0
                    out.iloc[at, 1] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1) + 0.0
                    out.iloc[at, 2] = (freq * p).sum(axis=1)
                return out.astype(float)

            for c in self.columns:
                new = {f"{self.prefix}_{c}_{k}": F.col(f"_s.{k}") for k in ("peak", "entropy", "centroid")}
                out = out.withColumn("_s", spectrum(F.col(c))).withColumns(new).drop("_s")
                self.new_columns += list(new)
        return out


def _same(value):
    return lambda x: x == value


class Histogram(Operator):
    """Shares of equally wide bins of every array's own range, and entropy."""

    def __init__(self, columns, bins=8, prefix="img"):
        super().__init__(columns)
        self.bins, self.prefix = bins, prefix

    def _cell(self, lo: Column, width: Column):
        return lambda x: F.when(width > 0, F.least(F.floor(F.try_divide(x.cast("double") - lo, width)), F.lit(self.bins - 1))).otherwise(0)

    def expressions(self, df):
        out = {}
        for c in self.columns:
            a, n = F.col(c), F.size(c)
            lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
            width = (hi - lo) / self.bins
            cell = F.transform(a, self._cell(lo, width))
            share = [F.try_divide(F.size(F.filter(cell, _same(i))), n) for i in range(self.bins)]
            out |= {f"{self.prefix}_{c}_hist_{i}": F.when(n > 0, s) for i, s in enumerate(share)}
            out[f"{self.prefix}_{c}_hist_entropy"] = F.when(n > 0, sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0)))
        return out


def fuse(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``fused_pc_<i>``: principal components of columns (centred)."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(x).transform(x)
    x = PCA(k=k, inputCol="_c", outputCol="_p").fit(x).transform(x).withColumn("_a", vector_to_array("_p"))
    return x.withColumns({f"fused_pc_{i}": F.col("_a")[i] for i in range(k)}).drop("_v", "_c", "_p", "_a")
