"""Feature packs of some domains, each one projection (or two, where a feature
builds on another)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.functions.quantiles import Quantile
from millrace.operators.base import run_aggregates
from millrace.operators.temporal import percent_rank, stamp


def ecommerce(df: DataFrame, customer: str, amount: str, time: str, product: str | None = None) -> DataFrame:
    """Recency, frequency and money of a row's customer, as of the last order."""
    g, a = Window.partitionBy(customer), F.col(amount).cast("double")
    s = run_aggregates(df, {"m": F.avg(a), "sd": F.stddev_samp(a), "last": F.max(F.unix_micros(stamp(time)))})
    ts = F.unix_micros(stamp(time))
    n = F.count(a).over(g)
    span = (F.max(ts).over(g) - F.min(ts).over(g)) / 86400e6
    new = {
        "ecommerce_amount_zscore": (a - F.lit(s["m"])) / F.lit(s["sd"] or 1.0),
        "ecommerce_total_spend": F.sum(a).over(g),
        "ecommerce_avg_order_value": F.avg(a).over(g),
        "ecommerce_order_count": n,
        "ecommerce_spend_std": F.coalesce(F.stddev_samp(a).over(g), F.lit(0.0)),
        "ecommerce_is_repeat_customer": (n > 1).cast("int"),
        "ecommerce_days_since_last": (F.lit(s["last"]) - F.max(ts).over(g)) / 86400e6,
        "ecommerce_days_since_first": (F.lit(s["last"]) - F.min(ts).over(g)) / 86400e6,
        "ecommerce_purchase_frequency": n / (span + 1),
    }
    if product:
        new["ecommerce_unique_products"] = F.size(F.collect_set(product).over(g))
    return df.withColumns(new)


def finance(df: DataFrame, price: str, order: list[str], by: list[str] | None = None, volume: str | None = None, windows=(5, 10, 20)) -> DataFrame:
    """Returns, moving averages, momentum, RSI, Bollinger bands, drawdown, VWAP."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    p = F.col(price).cast("double")
    before, so_far = F.lag(p).over(w), w.rowsBetween(Window.unboundedPreceding, 0)
    step = p - before
    out = df.withColumns({"_step": step, "finance_returns": S.ratio(step, before, None), "finance_log_returns": F.when((p > 0) & (before > 0), F.ln(p / before))})
    new: dict[str, Column] = {}
    for n in windows:
        frame = w.rowsBetween(1 - n, 0)
        full = F.count(p).over(frame) >= n
        new |= {
            f"finance_sma_{n}": F.when(full, F.avg(p).over(frame)),
            f"finance_volatility_{n}": F.when(F.count("finance_returns").over(frame) >= n, F.stddev_samp("finance_returns").over(frame)),
            f"finance_momentum_{n}": p - F.lag(p, n).over(w),
            f"finance_roc_{n}": S.ratio(p - F.lag(p, n).over(w), F.lag(p, n).over(w), None),
        }
    rsi = w.rowsBetween(-13, 0)
    up = F.avg(F.when(F.col("_step") > 0, F.col("_step")).otherwise(F.when(F.col("_step").isNotNull(), 0.0))).over(rsi)
    down = F.avg(F.when(F.col("_step") < 0, -F.col("_step")).otherwise(F.when(F.col("_step").isNotNull(), 0.0))).over(rsi)
    new["finance_rsi_14"] = F.when(F.count("_step").over(rsi) >= 14, F.when(up + down > 0, 100 * up / (up + down)).otherwise(50.0))
    band = w.rowsBetween(-19, 0)
    full = F.count(p).over(band) >= 20
    for sign, name in ((2, "upper"), (-2, "lower")):
        new[f"finance_bollinger_{name}"] = F.when(full, F.avg(p).over(band) + sign * F.stddev_samp(p).over(band))
    top = F.max(p).over(so_far)
    out = out.withColumns(new | {"finance_drawdown": S.ratio(p - top, top, 0.0)})
    more = {"finance_max_drawdown": F.min("finance_drawdown").over(so_far)}
    if volume:
        v = F.col(volume).cast("double")
        more |= {
            "finance_vwap": S.ratio(F.sum(p * v).over(so_far), F.sum(v).over(so_far), None),
            "finance_obv": F.sum(F.coalesce(F.signum(F.col("_step")), F.lit(0.0)) * v).over(so_far),
        }
    return out.withColumns(more).drop("_step")


def geospatial(df: DataFrame, lat: str, lon: str, points: dict[str, tuple[float, float]] | None = None, clusters: int | None = None) -> DataFrame:
    a, b = F.col(lat).cast("double"), F.col(lon).cast("double")
    ra, rb = F.radians(a), F.radians(b)
    s = run_aggregates(df, {"lat": F.avg(a), "lon": F.avg(b), **{f"{n}{i}": f(x) for n, x in (("a", a), ("b", b)) for i, f in enumerate((F.min, F.max))}})
    new = {
        "geo_lat_sin": F.sin(ra), "geo_lat_cos": F.cos(ra), "geo_lon_sin": F.sin(rb), "geo_lon_cos": F.cos(rb),
        "geo_x": F.cos(ra) * F.cos(rb), "geo_y": F.cos(ra) * F.sin(rb), "geo_z": F.sin(ra),
        "geo_centroid_distance": S.haversine(a, b, F.lit(s["lat"]), F.lit(s["lon"])),
    }
    for name, c, k in (("lat", a, "a"), ("lon", b, "b")):
        if s[f"{k}0"] is not None:
            new[f"geo_{name}_bin"] = S.right_closed(c, S.even_edges(s[f"{k}0"], s[f"{k}1"], 20, pad=True))
    for name, (x, y) in (points or {}).items():
        new |= {f"geo_distance_{name}": S.haversine(a, b, F.lit(x), F.lit(y)), f"geo_bearing_{name}": S.bearing(a, b, F.lit(x), F.lit(y)), f"geo_manhattan_{name}": F.abs(a - x) + F.abs(b - y)}
    out = df.withColumns(new)
    if clusters:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        v = VectorAssembler(inputCols=["geo_x", "geo_y", "geo_z"], outputCol="_v", handleInvalid="skip").transform(out)
        out = KMeans(k=clusters, seed=42, featuresCol="_v", predictionCol="geo_cluster").fit(v).transform(v).drop("_v")
    return out


def healthcare(df: DataFrame, weight=None, height=None, age=None, systolic=None, diastolic=None, labs=()) -> DataFrame:
    new: dict[str, Column] = {}
    if weight and height:
        bmi = S.ratio(F.col(weight).cast("double"), F.pow(F.col(height).cast("double") / 100, 2), None)
        new |= {"health_bmi": bmi, "health_bmi_category": F.when(bmi <= 18.5, "underweight").when(bmi <= 25, "normal").when(bmi <= 30, "overweight").when(bmi.isNotNull(), "obese")}
    if age:
        a = F.col(age)
        new |= {"health_age_decade": F.floor(a / 10), "health_is_elderly": (a >= 65).cast("int"), "health_age_group": F.when(a <= 18, "child").when(a <= 40, "young").when(a <= 65, "middle").when(a.isNotNull(), "senior")}
    if systolic and diastolic:
        s, d = F.col(systolic).cast("double"), F.col(diastolic).cast("double")
        new |= {"health_pulse_pressure": s - d, "health_mean_pressure": d + (s - d) / 3, "health_bp_category": F.when((s < 120) & (d < 80), "normal").when((s < 130) & (d < 80), "elevated").when((s < 140) | (d < 90), "stage1").when(s.isNotNull() & d.isNotNull(), "stage2")}
    if labs:
        st = run_aggregates(df, {f"{c}|{k}": f for c in labs for k, f in (("m", F.avg(c)), ("s", F.stddev_samp(c)), ("q", Quantile(F.col(c), (0.01, 0.99))))})
        for c in labs:
            lo, hi = st[f"{c}|q"] or (None, None)
            new |= {f"health_{c}_zscore": (F.col(c) - F.lit(st[f"{c}|m"])) / F.lit(st[f"{c}|s"] or 1.0), f"health_{c}_critical": ((F.col(c) < lo) | (F.col(c) > hi)).cast("int")}
    return df.withColumns(new)


def iot(df: DataFrame, sensor: str, order: list[str], by: list[str] | None = None, window: int = 10) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    frame, v = w.rowsBetween(1 - window, 0), F.col(sensor).cast("double")
    s = run_aggregates(df, {"m": F.avg(v), "lo": F.min(v), "hi": F.max(v)})
    mean, sd = F.avg(v).over(frame), F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0))
    dev = v - F.lit(s["m"])
    out = df.withColumns({
        f"iot_{sensor}_mean": mean, f"iot_{sensor}_std": sd, f"iot_{sensor}_min": F.min(v).over(frame), f"iot_{sensor}_max": F.max(v).over(frame),
        f"iot_{sensor}_rate": v - F.lag(v).over(w), f"iot_{sensor}_deviation": F.abs(v - mean), f"iot_{sensor}_energy": F.sum(v * v).over(frame),
        f"iot_{sensor}_snr": S.ratio(mean, sd, 0.0), f"iot_{sensor}_cumsum": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        f"iot_{sensor}_range": S.ratio(v - F.lit(s["lo"]), F.lit((s["hi"] or 0.0) - (s["lo"] or 0.0)), 0.0),
        "_cross": ((F.signum(dev) != F.signum(F.lag(dev).over(w)))).cast("int"),
    })
    return out.withColumn(f"iot_{sensor}_crossings", F.avg("_cross").over(frame)).drop("_cross")


def marketing(df: DataFrame, revenue: str, frequency: str, recency: str) -> DataFrame:
    s = run_aggregates(df, {"q": Quantile(F.col(revenue), 0.75), "m": F.avg(revenue), "sd": F.stddev_samp(revenue)})
    out = df
    for c in (revenue, frequency, recency):
        out = percent_rank(out, c)
    rfm = (F.col(f"{revenue}_rank") + F.col(f"{frequency}_rank") + (1 - F.col(f"{recency}_rank"))) / 3
    return out.withColumns({
        "marketing_rfm_score": rfm, "marketing_log_revenue": S.log1p(F.col(revenue).cast("double")), "marketing_is_high_value": (F.col(revenue) >= s["q"]).cast("int"),
        "marketing_revenue_zscore": (F.col(revenue) - F.lit(s["m"])) / F.lit(s["sd"] or 1.0), "marketing_revenue_per_visit": S.ratio(F.col(revenue).cast("double"), F.col(frequency).cast("double"), 0.0),
    })


PACKS = {"ecommerce": ecommerce, "finance": finance, "geospatial": geospatial, "healthcare": healthcare, "iot": iot, "marketing": marketing}
