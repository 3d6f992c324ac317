"""Registered queries over the driver's tables, with their SQL.

Every query projects a key, rounds floating-point results, and has no order.
Those whose rows SQL cannot give (models, seeded sampling, streams with state)
have no SQL and are tested by themselves.
"""

from __future__ import annotations

import itertools
import math
import random
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import concordance
from millrace.operators import aggregates, arrays, base, categorical, cleaning, graph, lineage, loess, monitoring, numeric, packs, profiling, relational, search, selection, temporal, text
from millrace.plans import dsl
from millrace.plans.auto import AutoFeatures
from millrace.sources import io
from millrace.streaming import sketches, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LKEY = "l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return io.read(spark, f"{sf}/{name}.parquet")


def out(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Plain types: doubles rounded, whole numbers long."""
    kinds = {f.name: f.dataType for f in df.schema}
    made = []
    for c in cols or df.columns:
        v = F.col(f"`{c}`")
        if isinstance(kinds[c], (T.DoubleType, T.FloatType, T.DecimalType)):
            v = F.round(v.cast("double"), digits)
        elif isinstance(kinds[c], (T.IntegralType, T.BooleanType)):
            v = v.cast("long")
        made.append(v.alias(c))
    return df.select(*made)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Features of order lines: logarithm, product, winsorised price, segment
    encoding, season."""
    lines, orders, customers = read(spark, sf, "lineitem"), read(spark, sf, "orders"), read(spark, sf, "customer")
    # Orders meet their customers first, so lines move once.
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_mktsegment")
    df = lines.join(known, F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.select(*LINE, "l_quantity", "l_discount", "l_extendedprice", "o_orderdate", "c_mktsegment")
    # What is fitted reads two written columns, not the joins once for each of its passes.
    fitted = graph.cut(df.select("l_extendedprice", "c_mktsegment"))
    df = categorical.Target(["c_mktsegment"]).fit(fitted, "l_extendedprice").transform(df)
    both = base.Union([numeric.Log(["l_extendedprice"]), numeric.Interactions(["l_quantity", "l_discount"], ("multiply",)), temporal.DateParts(["o_orderdate"], ("month",))])
    df = both.fit_transform(df)
    df = cleaning.Winsorize(["l_extendedprice"]).fit(fitted).transform(df).withColumnRenamed("l_extendedprice", "l_extendedprice_wins")
    return out(df, *LINE, "l_extendedprice_log1p", "l_quantity_x_l_discount", "l_extendedprice_wins", "c_mktsegment_target", "o_orderdate_month_sin", digits=4)


QUERIES["flagship"] = flagship
SQL["flagship"] = f"""
with j as (select * from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
b as (select quantile_cont(l_extendedprice, 0.01) lo, quantile_cont(l_extendedprice, 0.99) hi, avg(l_extendedprice) gm from j),
g as (select c_mktsegment, count(l_extendedprice) n, avg(l_extendedprice) m from j group by 1)
select {LKEY}, round(ln(1 + greatest(abs(l_extendedprice), 0)), 4) as l_extendedprice_log1p, round(l_quantity * l_discount, 4) as l_quantity_x_l_discount,
  round(least(greatest(l_extendedprice, lo), hi), 4) as l_extendedprice_wins, round((n * m + 10 * gm) / (n + 10), 4) as c_mktsegment_target,
  round(sin(2 * pi() * month(o_orderdate) / 12), 4) as o_orderdate_month_sin
from j join g using (c_mktsegment) cross join b"""

# Numbers


@query(f"""select {LKEY}, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount, round(case when l_discount = 0 then 0 else l_quantity / l_discount end, 6) as l_quantity_div_l_discount,
  round(l_quantity + l_discount, 6) as l_quantity_plus_l_discount, round(case when l_quantity + l_discount = 0 then 0 else (l_quantity - l_discount) / (l_quantity + l_discount) end, 6) as l_quantity_ratio_l_discount from lineitem""")
def interactions(spark, sf):
    df = numeric.Interactions(["l_quantity", "l_discount"], ("multiply", "divide", "add", "ratio")).fit_transform(read(spark, sf, "lineitem"))
    return out(df, *LINE, "l_quantity_x_l_discount", "l_quantity_div_l_discount", "l_quantity_plus_l_discount", "l_quantity_ratio_l_discount")


@query(f"""select {LKEY}, round(l_tax - l_discount, 6) as l_tax_minus_l_discount, round(case when l_discount = 0 then 0 else l_tax / l_discount end, 6) as l_tax_over_l_discount,
  round(case when l_discount = 0 then 0 else (l_tax - l_discount) / abs(l_discount) end, 6) as l_tax_pct_change_l_discount from lineitem""")
def differences(spark, sf):
    return out(numeric.Differences([("l_tax", "l_discount")]).fit_transform(read(spark, sf, "lineitem")), *LINE, "l_tax_minus_l_discount", "l_tax_over_l_discount", "l_tax_pct_change_l_discount")


@query("""with m as (select min(c_acctbal) lo from customer)
select c_custkey, round(ln(1 + greatest(abs(c_acctbal), 0)), 6) as abs_log1p, round(case when v > 0 then ln(v) else 0 end, 6) as shift_log, round(case when c_acctbal > 0 then log10(c_acctbal) else 0 end, 6) as raw_log10
from (select c_custkey, c_acctbal, c_acctbal + case when lo <= 0 then abs(lo) + 1 else 0 end as v from customer, m)""")
def logarithms(spark, sf):
    df, c = read(spark, sf, "customer"), ["c_acctbal"]
    df = numeric.Log(c).fit_transform(df).withColumnRenamed("c_acctbal_log1p", "abs_log1p")
    df = numeric.Log(c, "log", "shift").fit_transform(df).withColumnRenamed("c_acctbal_log", "shift_log")
    df = numeric.Log(c, "log10", "raw").fit_transform(df).withColumnRenamed("c_acctbal_log10", "raw_log10")
    return out(df, "c_custkey", "abs_log1p", "shift_log", "raw_log10")


@query("""select p_partkey, round(sqrt(p_retailprice), 6) as p_retailprice_sqrt, round(p_retailprice * p_retailprice, 4) as p_retailprice_square, round(cbrt(p_retailprice), 6) as p_retailprice_cbrt from part""")
def powers(spark, sf):
    df = numeric.Power(["p_retailprice"], ("sqrt", "square", "cbrt")).fit_transform(read(spark, sf, "part"))
    df = df.withColumn("p_retailprice_square", F.round("p_retailprice_square", 4))
    return out(df, "p_partkey", "p_retailprice_sqrt", "p_retailprice_square", "p_retailprice_cbrt")


@query("""select p_partkey, round(p_size * p_size, 6)::double as "p_size^2", round(p_size * p_retailprice, 4) as p_size_x_p_retailprice from part""")
def polynomial(spark, sf):
    df = numeric.Polynomial(["p_size", "p_retailprice"]).fit_transform(read(spark, sf, "part"))
    return out(df, "p_partkey", "p_size^2", "p_size_x_p_retailprice", digits=4)


@query(f"""with e as (select quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) q, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem)
select {LKEY}, (case when l_extendedprice >= q[1] then 1 else 0 end + case when l_extendedprice >= q[2] then 1 else 0 end + case when l_extendedprice >= q[3] then 1 else 0 end + case when l_extendedprice >= q[4] then 1 else 0 end)::bigint as quantile_bin,
 (case when l_extendedprice >= lo + (hi - lo) * 1 / 5 then 1 else 0 end + case when l_extendedprice >= lo + (hi - lo) * 2 / 5 then 1 else 0 end + case when l_extendedprice >= lo + (hi - lo) * 3 / 5 then 1 else 0 end + case when l_extendedprice >= lo + (hi - lo) * 4 / 5 then 1 else 0 end)::bigint as uniform_bin from lineitem, e""")
def bins(spark, sf):
    df, c = read(spark, sf, "lineitem"), ["l_extendedprice"]
    df = numeric.Bins(c).fit_transform(df).withColumnRenamed("l_extendedprice_binned", "quantile_bin")
    df = numeric.Bins(c, strategy="uniform").fit_transform(df).withColumnRenamed("l_extendedprice_binned", "uniform_bin")
    return out(df, *LINE, "quantile_bin", "uniform_bin")


@query("""with q as (select quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) q from part)
select p_partkey, (case when p_retailprice > q[1] then 1 else 0 end + case when p_retailprice > q[2] then 1 else 0 end + case when p_retailprice > q[3] then 1 else 0 end)::bigint as p_retailprice_binned from part, q""")
def qcut(spark, sf):
    return out(numeric.Bins(["p_retailprice"], 4, closed="right").fit_transform(read(spark, sf, "part")), "p_partkey", "p_retailprice_binned")


@query("""with q as (select quantile_cont(p_size, [0.0, 0.25, 0.5, 0.75, 1.0]) k from part), p as (select p_partkey, p_size::double v, k from part, q)
select p_partkey, round(case when v >= k[1] and v < k[2] then (k[2] - v) / (k[2] - k[1]) else 0 end, 6) as p_size_spline_0,
 round(case when v >= k[1] and v < k[2] then (v - k[1]) / (k[2] - k[1]) when v >= k[2] and v < k[3] then (k[3] - v) / (k[3] - k[2]) else 0 end, 6) as p_size_spline_1,
 round(case when v >= k[4] and v <= k[5] then (v - k[4]) / (k[5] - k[4]) else 0 end, 6) as p_size_spline_4 from p""")
def spline(spark, sf):
    return out(numeric.Spline(["p_size"], degree=1).fit_transform(read(spark, sf, "part")), "p_partkey", "p_size_spline_0", "p_size_spline_1", "p_size_spline_4")


@query("""select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) as value_zscore, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) as value_minmax from events""")
def scaling(spark, sf):
    df = base.Union([numeric.Scale(["value"]), numeric.Scale(["value"], "minmax")]).fit_transform(read(spark, sf, "events"))
    return out(df, "event_id", "value_zscore", "value_minmax")


@query(f"""select {LKEY}, round(avg(l_quantity) over w, 6) as l_returnflag_l_linestatus_l_quantity_mean, round(sum(l_quantity) over w, 4) as l_returnflag_l_linestatus_l_quantity_sum,
 round(stddev_samp(l_quantity) over w, 6) as l_returnflag_l_linestatus_l_quantity_std from lineitem window w as (partition by l_returnflag, l_linestatus)""")
def group_statistics(spark, sf):
    df = numeric.GroupStatistics(["l_returnflag", "l_linestatus"], ["l_quantity"]).fit_transform(read(spark, sf, "lineitem"))
    return out(df, *LINE, *[c for c in df.columns if c.startswith("l_returnflag_l_")])


@query("""select c_custkey, round(median(o_totalprice), 4) as o_custkey_o_totalprice_median, count(o_totalprice) as o_custkey_o_totalprice_count, count(distinct o_orderstatus) as o_custkey_o_orderstatus_nunique
 from customer left join orders on c_custkey = o_custkey group by 1 having count(o_totalprice) > 0""")
def category_statistics(spark, sf):
    orders = read(spark, sf, "orders")
    a = numeric.GroupStatistics("o_custkey", ["o_totalprice"], ("median", "count"))
    b = numeric.GroupStatistics("o_custkey", ["o_orderstatus"], ("nunique",))
    df = b.fit(orders).transform(a.fit(orders).transform(orders))
    df = df.withColumn("o_custkey_o_totalprice_median", F.round("o_custkey_o_totalprice_median", 4))
    return out(df.withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", *[c for c in df.columns if c.startswith("o_custkey_")]).distinct())


# Categories


@query("""select event_id, (event_type = 'click')::bigint as event_type_click, (event_type = 'purchase')::bigint as event_type_purchase from events""")
def onehot(spark, sf):
    df = categorical.OneHot(["event_type"]).fit_transform(read(spark, sf, "events"))
    df = df.withColumns({c: F.lit(0) for c in ("event_type_click", "event_type_purchase") if c not in df.columns})
    return out(df, "event_id", "event_type_click", "event_type_purchase")


@query("""with c as (select p_brand, count(*) n from part group by 1), r as (select p_brand, row_number() over (order by n desc, p_brand) - 1 as f, row_number() over (order by p_brand) - 1 as a, n from c)
select p_partkey, f::bigint as by_frequency, a::bigint as by_alphabet, round(n / (select count(*) from part), 6) as p_brand_freq from part join r using (p_brand)""")
def ordinal_frequency(spark, sf):
    df = read(spark, sf, "part")
    df = categorical.Ordinal(["p_brand"]).fit_transform(df).withColumnRenamed("p_brand_ordinal", "by_frequency")
    df = categorical.Ordinal(["p_brand"], by="alphabet").fit_transform(df).withColumnRenamed("p_brand_ordinal", "by_alphabet")
    return out(categorical.Frequency(["p_brand"]).fit_transform(df), "p_partkey", "by_frequency", "by_alphabet", "p_brand_freq")


_OC = "(select * from orders join customer on o_custkey = c_custkey)"


def _orders_customers(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(f"""with j as (select * from {_OC}), g as (select avg(o_totalprice) gm from j), c as (select c_mktsegment, count(o_totalprice) n, avg(o_totalprice) m, sum(o_totalprice) s, stddev_samp(o_totalprice) sd from j group by 1)
select o_orderkey, round((n * m + 10 * gm) / (n + 10), 4) as c_mktsegment_target, round(sd, 4) as c_mktsegment_target_std, n as c_mktsegment_target_count,
 round((s + gm) / (n + 1), 4) as c_mktsegment_prior, round((s - o_totalprice + gm) / n, 4) as c_mktsegment_loo from j join c using (c_mktsegment) cross join g""")
def target_encoders(spark, sf):
    df, c, y = _orders_customers(spark, sf), ["c_mktsegment"], "o_totalprice"
    df = categorical.Target(c).fit_transform(df, y)
    df = categorical.TargetStatistics(c, ("std", "count")).fit_transform(df, y)
    df = categorical.Prior(c).fit_transform(df, y)
    df = categorical.LeaveOneOut(c, exclude_own=True).fit_transform(df, y)
    return out(df, "o_orderkey", "c_mktsegment_target", "c_mktsegment_target_std", "c_mktsegment_target_count", "c_mktsegment_prior", "c_mktsegment_loo", digits=4)


@query("""with j as (select * from documents join labels using (doc_id)), t as (select sum(quality) e, sum(1 - quality) r from j), c as (select lang, sum(quality) e, sum(1 - quality) r from j group by 1)
select doc_id, round(ln(((c.e + 0.5) / (t.e + 0.5)) / ((c.r + 0.5) / (t.r + 0.5))), 6) as lang_woe from j join c using (lang) cross join t""")
def weight_of_evidence(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return out(categorical.WeightOfEvidence(["lang"]).fit_transform(df, "quality"), "doc_id", "lang_woe")


@query("""with j as (select * from documents join labels using (doc_id)), t as (select sum(quality) e, sum(1 - quality) r from j), c as (select lang, sum(quality) e, sum(1 - quality) r from j group by 1)
select round(sum(((c.e + 0.5) / (t.e + 0.5) - (c.r + 0.5) / (t.r + 0.5)) * ln(((c.e + 0.5) / (t.e + 0.5)) / ((c.r + 0.5) / (t.r + 0.5)))), 6) as iv from c, t""")
def information_value(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return out(categorical.WeightOfEvidence(["lang"]).fit(df, "quality").information(df, "lang", "quality"))


_HASH = ", ".join(f"(case when b = {i} then 1 when b = {i + 8} then -1 else 0 end)::bigint as event_type_hash_{i}" for i in range(8))


@query(f"""select event_id, {_HASH} from (select event_id, (('0x' || right(md5(event_type || '0'), 8))::bigint % 16) as b from events)""")
def hashing(spark, sf):
    df = categorical.Hashing(["event_type"]).fit_transform(read(spark, sf, "events"))
    return out(df, "event_id", *[f"event_type_hash_{i}" for i in range(8)])


@query(f"""with k as (select l_returnflag || '_x_' || l_linestatus v from lineitem group by 1 having count(*) >= 500)
select {LKEY}, case when l_returnflag || '_x_' || l_linestatus in (select v from k) then l_returnflag || '_x_' || l_linestatus else '__other__' end as l_returnflag_x_l_linestatus from lineitem""")
def combine(spark, sf):
    return out(categorical.Combine(["l_returnflag", "l_linestatus"], least=500).fit_transform(read(spark, sf, "lineitem")), *LINE, "l_returnflag_x_l_linestatus")


@query()
def embeddings_of_categories(spark, sf):
    df = categorical.Embedding(["c_mktsegment"], dim=3).fit_transform(read(spark, sf, "customer"))
    return out(df, "c_custkey", *[f"c_mktsegment_emb_{i}" for i in range(3)])


def _layers(columns, layers=2, seed=0):
    """The layers' formulas over z-scores z0, z1, ...: weights come from the seed."""
    rng, k, made, names = random.Random(seed), len(columns), [], []
    prev = [f"z{i}" for i in range(k)]
    for layer in range(1, layers + 1):
        weights = [[rng.gauss(0, 1) / math.sqrt(k) for _ in range(k)] for _ in range(k)]
        shifts = [rng.gauss(0, 0.01) for _ in range(k)]
        mixed = ["(" + " + ".join(f"{w!r}::double * {p}" for w, p in zip(row, prev, strict=True)) + ")" for row in weights]
        prev = [f"cross_L{layer}_d{d}" for d in range(k)]
        made.append(", ".join(f"z{d} * {mixed[d]} + {shifts[d]!r}::double + {mixed[d]} as {prev[d]}" for d in range(k)))
        names += prev
    z = ", ".join(f"coalesce(({c} - avg({c}) over ()) / stddev_samp({c}) over (), 0) as z{i}" for i, c in enumerate(columns))
    sql = f"select {LKEY}, {z} from lineitem"
    for m in made:
        sql = f"select *, {m} from ({sql})"
    return f"select {', '.join(LINE)}, {', '.join(f'round({n}, 6) as {n}' for n in names)} from ({sql})"


@query(_layers(["l_quantity", "l_discount", "l_tax"]))
def cross_layers(spark, sf):
    df = numeric_only = categorical.CrossLayers(["l_quantity", "l_discount", "l_tax"]).fit_transform(read(spark, sf, "lineitem"))
    return out(df, *LINE, *[c for c in numeric_only.columns if c.startswith("cross_")])


# Times


@query("""select o_orderkey, year(o_orderdate)::bigint as o_orderdate_year, month(o_orderdate)::bigint as o_orderdate_month, day(o_orderdate)::bigint as o_orderdate_day, (isodow(o_orderdate) - 1)::bigint as o_orderdate_dayofweek,
 (isodow(o_orderdate) >= 6)::bigint as o_orderdate_is_weekend, weekofyear(o_orderdate)::bigint as o_orderdate_weekofyear, quarter(o_orderdate)::bigint as o_orderdate_quarter, dayofyear(o_orderdate)::bigint as o_orderdate_dayofyear,
 (day(o_orderdate) = 1)::bigint as o_orderdate_is_month_start, (o_orderdate::date = last_day(o_orderdate::date))::bigint as o_orderdate_is_month_end,
 (month(o_orderdate) in (3, 6, 9, 12) and o_orderdate::date = last_day(o_orderdate::date))::bigint as o_orderdate_is_quarter_end, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) as o_orderdate_dayofweek_cos from orders""")
def date_parts(spark, sf):
    parts = ("year", "month", "day", "dayofweek", "is_weekend", "weekofyear", "quarter", "dayofyear", "is_month_start", "is_month_end", "is_quarter_end")
    df = temporal.DateParts(["o_orderdate"], parts).fit_transform(read(spark, sf, "orders"))
    return out(df, "o_orderkey", *[f"o_orderdate_{p}" for p in parts], "o_orderdate_dayofweek_cos")


@query("""with d as (select o_orderkey, o_orderdate::date d from orders), h as (select o_orderkey, d, make_date(year(d) + y, m, x) h from d, (values (-1), (0), (1)) v(y), (values (1, 1), (7, 4), (12, 25), (12, 31)) w(m, x)),
 g as (select o_orderkey, min(case when h >= d then h - d end)::bigint a, min(case when h <= d then d - h end)::bigint b from h group by 1)
select o_orderkey, (a = 0)::bigint as o_orderdate_is_holiday, a as o_orderdate_days_to_holiday, b as o_orderdate_days_from_holiday, (least(a, b) <= 2)::bigint as o_orderdate_near_holiday from g""")
def holidays(spark, sf):
    df = temporal.Holidays(["o_orderdate"]).fit_transform(read(spark, sf, "orders"))
    return out(df, "o_orderkey", *[f"o_orderdate_{k}" for k in ("is_holiday", "days_to_holiday", "days_from_holiday", "near_holiday")])


@query(f"""select {LKEY}, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6, 6) as o_orderdate_to_l_shipdate_days, round((epoch_us(timestamp '2000-01-01') - epoch_us(l_shipdate)) / 604800e6, 6) as l_shipdate_age_weeks from lineitem join orders on l_orderkey = o_orderkey""")
def time_differences(spark, sf):
    df = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = temporal.TimeDifference(["o_orderdate", "l_shipdate"], reference="2000-01-01", units=("days", "weeks")).fit_transform(df)
    return out(df, *LINE, "o_orderdate_to_l_shipdate_days", "l_shipdate_age_weeks")


@query("""with b as (select min(epoch_us(o_orderdate)) m from orders) select o_orderkey, round(sin(2 * pi() * (epoch_us(o_orderdate) - m) / 86400e6 / 365.25), 6) as fourier_yearly_sin_1,
 round(cos(2 * pi() * ((epoch_us(o_orderdate) - m) / 86400e6 * 2) / 7.0), 6) as fourier_weekly_cos_2 from orders, b""")
def fourier(spark, sf):
    return out(temporal.Fourier("o_orderdate", terms=2).fit_transform(read(spark, sf, "orders")), "o_orderkey", "fourier_yearly_sin_1", "fourier_weekly_cos_2")


_EV = {"by": "user_id", "order": ["ts", "event_id"]}
_EW = "window w as (partition by user_id order by ts, event_id)"


@query(f"""select event_id, round(lag(value, 1) over w, 6) as value_lag_1, round(coalesce(lag(value, 7) over w, -1), 6) as filled_lag_7 from events {_EW}""")
def lags(spark, sf):
    df = temporal.Lag(["value"], (1,), **_EV).fit_transform(read(spark, sf, "events"))
    df = temporal.Lag(["value"], (7,), fill=-1.0, **_EV).fit_transform(df).withColumnRenamed("value_lag_7", "filled_lag_7")
    return out(df, "event_id", "value_lag_1", "filled_lag_7")


@query(f"""select event_id, round(value - lag(value, 1) over w, 6) as value_diff_1, round((value - lag(value, 1) over w) / nullif(lag(value, 1) over w, 0), 4) as value_pct_change_1 from events {_EW}""")
def diffs(spark, sf):
    df = temporal.Diff(["value"], (1,), **_EV).fit_transform(read(spark, sf, "events"))
    return out(df.withColumn("value_pct_change_1", F.round("value_pct_change_1", 4)), "event_id", "value_diff_1", "value_pct_change_1")


@query("""select event_id, round(avg(value) over w, 6) as value_rolling_7_mean, round(case when count(value) over w > 1 then stddev_samp(value) over w end, 5) as value_rolling_7_std, round(quantile_cont(value, 0.5) over w, 6) as value_rolling_7_median,
 round(avg(value) over c, 6) as centered from events window w as (partition by user_id order by ts, event_id rows between 6 preceding and current row), c as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""")
def rolling(spark, sf):
    df = temporal.Rolling(["value"], (7,), ("mean", "std", "median"), **_EV).fit_transform(read(spark, sf, "events"))
    df = temporal.Rolling(["value"], (5,), ("mean",), center=True, **_EV).fit_transform(df).withColumnRenamed("value_rolling_5_mean", "centered")
    df = df.withColumn("value_rolling_7_std", F.round("value_rolling_7_std", 5))
    return out(df, "event_id", "value_rolling_7_mean", "value_rolling_7_std", "value_rolling_7_median", "centered")


@query("""select event_id, round(avg(value) over w, 9) as value_expanding_mean, round(max(value) over w, 9) as value_expanding_max, count(value) over w as value_expanding_count, round(sum(value) over w, 4) as value_cumsum, round(min(value) over w, 9) as value_cummin
 from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def expanding(spark, sf):
    df = temporal.Expanding(["value"], ("mean", "max", "count"), **_EV).fit_transform(read(spark, sf, "events"))
    df = temporal.Cumulative(["value"], **_EV).fit_transform(df).withColumn("value_cumsum", F.round("value_cumsum", 4))
    return out(df, "event_id", "value_expanding_mean", "value_expanding_max", "value_expanding_count", "value_cumsum", "value_cummin", digits=9)


@query("""with e as (select *, case when event_type = 'purchase' then epoch_us(ts) end p from events)
select event_id, round((min(p) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) - epoch_us(ts)) / 3600e6, 6) as time_to_next_bought_hours,
 round((epoch_us(ts) - max(p) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)) / 3600e6, 6) as time_since_last_bought_hours from e""")
def time_to_event(spark, sf):
    df = read(spark, sf, "events").withColumn("bought", F.col("event_type") == "purchase")
    df = temporal.TimeToEvent("ts", "bought", by="user_id", order=["ts", "event_id"], unit="hours").fit_transform(df)
    return out(df, "event_id", "time_to_next_bought_hours", "time_since_last_bought_hours")


@query("""with r as (select event_id, user_id, value, rank() over (partition by user_id order by value) r, count(*) over (partition by user_id, value) k, count(value) over (partition by user_id) n from events)
select event_id, round((r + (k - 1) / 2.0) / n, 6)::double as value_rank from r""")
def percent_ranks(spark, sf):
    return out(temporal.percent_rank(read(spark, sf, "events"), "value", ["user_id"]), "event_id", "value_rank")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) i from events), p as (select a.event_id, b.value x, power(2 / 3.0::double, a.i - b.i) w from e a join e b on a.user_id = b.user_id and b.i <= a.i),
 m as (select event_id, sum(w) s, sum(w * w) q, sum(w * x) / sum(w) m, count(*) n from p group by 1), d as (select event_id, sum(w * (x - m) * (x - m)) d from p join m using (event_id) group by 1)
select event_id, round(m, 6) as value_ewm_5_mean, round(case when n > 1 then sqrt(d * s / (s * s - q)) end, 6) as value_ewm_5_std from m join d using (event_id)""")
def exponential_means(spark, sf):
    df = temporal.exponential(read(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["value"], ["user_id"], ["ts", "event_id"], (5,))
    return out(df, "event_id", "value_ewm_5_mean", "value_ewm_5_std")


@query("""with m as (select o_custkey % 10 as grp, o_orderdate::date as d, sum(o_totalprice) v from orders group by 1, 2), w as (select *, avg(v) over x t, count(v) over x n, (row_number() over (partition by grp order by d) - 1) % 7 ph from m window x as (partition by grp order by d rows between 3 preceding and 3 following)),
 r as (select *, case when n = 7 then v - t end rest from w), s as (select *, avg(rest) over (partition by grp, ph) pm from r)
select grp, strftime(d, '%Y-%m-%d') as day, round(case when n = 7 then t end, 3) as v_trend, round(pm - avg(pm) over (partition by grp), 3) as v_seasonal from s""")
def seasonal(spark, sf):
    df = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("grp"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    df = temporal.decompose(df, "v", 7, ["grp"], ["d"]).withColumn("day", F.date_format("d", "yyyy-MM-dd"))
    return out(df, "grp", "day", "v_trend", "v_seasonal", digits=3)


# Text


@query(r"""with t as (select doc_id, text, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '') w from documents)
select doc_id, length(text)::bigint as text_char_count, len(w)::bigint as text_word_count, len(list_distinct(list_transform(w, lambda x: lower(x))))::bigint as text_unique_word_count,
 length(regexp_replace(text, '[^0-9]', '', 'g'))::bigint as text_digit_count, length(regexp_replace(text, '\P{Lu}', '', 'g'))::bigint as text_upper_count, length(regexp_replace(text, '[a-zA-Z0-9\s]', '', 'g'))::bigint as text_special_count from t""")
def text_basic(spark, sf):
    names = ["char_count", "word_count", "unique_word_count", "digit_count", "upper_count", "special_count"]
    return out(text.TextBasic(["text"], names).fit_transform(read(spark, sf, "documents")), "doc_id", *[f"text_{n}" for n in names])


@query(r"""select doc_id, len(regexp_extract_all(text, '(?i)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))::bigint as text_email_count, len(regexp_extract_all(text, '(?i)https?://[^\s]+'))::bigint as text_url_count,
 (len(regexp_extract_all(text, '[0-9]+')) > 0)::bigint as text_has_number from documents""")
def text_patterns(spark, sf):
    return out(text.TextPatterns(["text"]).fit_transform(read(spark, sf, "documents")), "doc_id", "text_email_count", "text_url_count", "text_has_number")


@query(r"""with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+'), lambda x: true) w from documents),
 v as (select x, count(*) df from (select unnest(list_distinct(w)) x from t) group by 1 having count(*) >= 2 order by df desc, x limit 20)
select doc_id, sum(len(list_filter(w, lambda y: y = x)))::bigint as total, count(*) filter (where list_contains(w, x))::bigint as present from t, v group by 1""")
def term_counts(spark, sf):
    m = text.TermCounts(["text"], most=20).fit(read(spark, sf, "documents"))
    df = m.transform(read(spark, sf, "documents"))
    cols = [F.col(f"`{c}`") for c in m.new_columns]
    return out(df.select("doc_id", sum(cols, F.lit(0)).alias("total"), sum(((c > 0).cast("int") for c in cols), F.lit(0)).alias("present")))


@query(r"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+') w from documents), c as (select count(*) n from documents),
 v as (select x, count(*) df from (select unnest(list_distinct(w)) x from t) group by 1 having count(*) >= 2 and count(*) <= 0.95 * (select n from c) order by df desc, x limit 10),
 k as (select doc_id, x, len(list_filter(w, lambda y: y = x)) / greatest(len(w), 1) * (ln((n + 1) / (df + 1)) + 1) as k from t, v, c), l as (select doc_id, sqrt(sum(k * k)) l from k group by 1)
select doc_id, round(sum(case when l > 0 then k / l else 0 end), 6) as total, round(max(case when l > 0 then k / l else 0 end), 6) as largest from k join l using (doc_id) group by 1""")
def tfidf(spark, sf):
    m = text.TfIdf(["text"], most=10, stop_words=False).fit(read(spark, sf, "documents"))
    cols = [F.col(f"`{c}`") for c in m.transform(read(spark, sf, "documents")).columns if c.startswith("text_tfidf_")]
    df = m.transform(read(spark, sf, "documents"))
    return out(df.select("doc_id", sum(cols, F.lit(0.0)).alias("total"), F.greatest(F.lit(0.0), *cols).alias("largest")))


@query("""select event_id, (props->>'$.k')::bigint as k from events""")
def json_extract(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_PERSONAL = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ip_address": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "credit_card": r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"}


@query(" union all ".join(rf"""select 'text' as "column", '{k}' as kind, count(*) filter (where len(regexp_extract_all(text, '\b(?:{p})\b')) > 0) as "values", coalesce(sum(len(regexp_extract_all(text, '\b(?:{p})\b'))), 0)::bigint as times from documents""" for k, p in _PERSONAL.items()))
def personal_data(spark, sf):
    return out(text.personal_inside(read(spark, sf, "documents"), ["text"], _PERSONAL))


# Cleaning

_HOLES = "(select event_id, event_type, user_id, case when event_id % 7 = 0 then null else value end v, case when event_id % 5 = 0 then null else event_type end t from events)"


def _holes(spark, sf):
    return read(spark, sf, "events").select("event_id", "event_type", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("t"))


@query(f"""with e as (select * from {_HOLES}), s as (select avg(v) a, median(v) m from e), c as (select t from e where t is not null group by 1 order by count(*) desc, t limit 1)
select event_id, round(coalesce(v, a), 6) as mean_v, round(coalesce(v, m), 6) as v, coalesce(e.t, c.t) as t, (v is null)::bigint as v_missing from e, s, c""")
def impute(spark, sf):
    df = _holes(spark, sf).withColumn("mean_v", F.col("v"))
    df = cleaning.Impute(["mean_v"], "mean").fit_transform(df)
    df = cleaning.Impute(["v", "t"], indicator=True).fit_transform(df)
    return out(df, "event_id", "mean_v", "v", "t", "v_missing")


@query(f"""with e as (select *, (case when v is null then '1' else '0' end) || (case when t is null then '1' else '0' end) p from {_HOLES}), c as (select p, row_number() over (order by count(*) desc, p) - 1 k from e group by 1)
select event_id, (v is null)::bigint as missing_v, (t is null)::bigint as missing_t, k::bigint as missing_pattern, ((v is null)::int + (t is null)::int)::bigint as n_missing from e join c using (p)""")
def missing_patterns(spark, sf):
    df = cleaning.MissingIndicator(["v", "t"]).fit_transform(_holes(spark, sf))
    return out(cleaning.MissingPattern(["v", "t"]).fit_transform(df), "event_id", "missing_v", "missing_t", "missing_pattern", "n_missing")


@query()
def knn_impute(spark, sf):
    df = read(spark, sf, "lineitem").select(*LINE, F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"), "l_extendedprice", "l_discount")
    return out(cleaning.NeighbourImpute(["q", "l_extendedprice", "l_discount"]).fit(df).transform(df))


@query("""with q as (select quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b, quantile_cont(o_totalprice, 0.01) lo, quantile_cont(o_totalprice, 0.99) hi from orders)
select o_orderkey, round(least(greatest(o_totalprice, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) as iqr, round(least(greatest(o_totalprice, lo), hi), 4) as wins, round(least(greatest(o_totalprice, 1000), 200000), 4) as given from orders, q""")
def caps(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", *[F.col("o_totalprice").alias(c) for c in ("iqr", "wins", "given")])
    for m in (cleaning.Cap(["iqr"]), cleaning.Winsorize(["wins"]), cleaning.CapAt({"given": (1000.0, 200000.0)})):
        df = m.fit_transform(df)
    return out(df, digits=4)


@query("""with q as (select quantile_cont(o_totalprice, 0.05) lo, quantile_cont(o_totalprice, 0.95) hi from orders) select o_orderkey, round(o_totalprice, 4) as o_totalprice from orders, q where o_totalprice between lo and hi""")
def trim(spark, sf):
    return out(cleaning.Trim(["o_totalprice"], "percentile", low=0.05, high=0.95).fit_transform(read(spark, sf, "orders")), "o_orderkey", "o_totalprice", digits=4)


# Packs


@query("""with m as (select max(epoch_us(o_orderdate)) l from orders) select o_orderkey, round(sum(o_totalprice) over w, 3) as ecommerce_total_spend, count(*) over w as ecommerce_order_count,
 round((l - max(epoch_us(o_orderdate)) over w) / 86400e6, 6) as ecommerce_days_since_last, (count(*) over w > 1)::bigint as ecommerce_is_repeat_customer from orders, m window w as (partition by o_custkey)""")
def pack_ecommerce(spark, sf):
    df = packs.ecommerce(read(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate").withColumn("ecommerce_total_spend", F.round("ecommerce_total_spend", 3))
    return out(df, "o_orderkey", "ecommerce_total_spend", "ecommerce_order_count", "ecommerce_days_since_last", "ecommerce_is_repeat_customer")


@query("""with e as (select *, value - lag(value) over w s, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) top from events window w as (partition by user_id order by ts, event_id)),
 g as (select *, avg(greatest(s, 0)) over r u, avg(greatest(-s, 0)) over r d, count(s) over r n, avg(value) over f sma, count(*) over f nf from e window r as (partition by user_id order by ts, event_id rows between 13 preceding and current row), f as (partition by user_id order by ts, event_id rows between 4 preceding and current row))
select event_id, round(case when nf >= 5 then sma end, 6) as finance_sma_5, round(case when n >= 14 then case when u + d > 0 then 100 * u / (u + d) else 50 end end, 4) as finance_rsi_14, round(case when top = 0 then 0 else (value - top) / top end, 6) as finance_drawdown from g""")
def pack_finance(spark, sf):
    df = packs.finance(read(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"])
    return out(df.withColumn("finance_rsi_14", F.round("finance_rsi_14", 4)), "event_id", "finance_sma_5", "finance_rsi_14", "finance_drawdown")


@query("""with s as (select avg(value) m from events), e as (select *, value - m d from events, s)
select event_id, round(avg(value) over f, 6) as iot_value_mean, round(sum(value * value) over f, 4) as iot_value_energy, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as iot_value_rate from e
 window f as (partition by user_id order by ts, event_id rows between 9 preceding and current row)""")
def pack_iot(spark, sf):
    df = packs.iot(read(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]).withColumn("iot_value_energy", F.round("iot_value_energy", 4))
    return out(df, "event_id", "iot_value_mean", "iot_value_energy", "iot_value_rate")


_GEO = "(select c_custkey, (c_custkey % 170) - 85.0 as lat, (c_custkey % 350) - 175.0 as lon from customer)"


@query(f"""select c_custkey, round(2 * 6371 * asin(sqrt(least(pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2), 1))), 4) as geo_distance_paris, round(cos(radians(lat)) * cos(radians(lon)), 4) as geo_x from {_GEO}""")
def pack_geo(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 170 - 85.0).alias("lat"), (F.col("c_custkey") % 350 - 175.0).alias("lon"))
    return out(packs.geospatial(df, "lat", "lon", {"paris": (48.85, 2.35)}), "c_custkey", "geo_distance_paris", "geo_x", digits=4)


# Revenue is rounded, as sums of doubles hang on their order and would leave ties to chance; scores of
# some thousand customers lie on halves of the fourth digit, so nine are given.
_RFM = "(select o_custkey, round(sum(o_totalprice), 4) rev, count(*) freq, date_diff('day', max(o_orderdate)::date, date '1999-01-01') rec from orders group by 1)"


@query(f"""with t as (select * from {_RFM}), r as (select *, (rank() over (order by rev) + (count(*) over (partition by rev) - 1) / 2.0) / count(*) over () a, (rank() over (order by freq) + (count(*) over (partition by freq) - 1) / 2.0) / count(*) over () b,
 (rank() over (order by rec) + (count(*) over (partition by rec) - 1) / 2.0) / count(*) over () c from t) select o_custkey, round((a + b + (1 - c)) / 3, 9)::double as marketing_rfm_score, (rev >= (select quantile_cont(rev, 0.75) from t))::bigint as marketing_is_high_value from r""")
def pack_marketing(spark, sf):
    df = read(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("rev"), F.count("*").alias("freq"), F.datediff(F.lit("1999-01-01").cast("date"), F.to_date(F.max("o_orderdate"))).alias("rec"))
    return out(packs.marketing(df, "rev", "freq", "rec"), "o_custkey", "marketing_rfm_score", "marketing_is_high_value", digits=9)


@query("""select p_partkey, round(w / pow(h / 100, 2), 4) as health_bmi, (a >= 65)::bigint as health_is_elderly, (a // 10)::bigint as health_age_decade from (select p_partkey, 40.0 + p_size w, 150.0 + p_size h, p_size + 20 a from part)""")
def pack_health(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", (F.col("p_size") + 40.0).alias("w"), (F.col("p_size") + 150.0).alias("h"), (F.col("p_size") + 20).alias("a"))
    return out(packs.healthcare(df, "w", "h", "a"), "p_partkey", "health_bmi", "health_is_elderly", "health_age_decade", digits=4)


# Several tables


def _graph(spark, sf):
    tables = {n: read(spark, sf, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    edges = [relational.Relationship("region", "r_regionkey", "nation", "n_regionkey"), relational.Relationship("nation", "n_nationkey", "customer", "c_nationkey"), relational.Relationship("customer", "c_custkey", "orders", "o_custkey"), relational.Relationship("orders", "o_orderkey", "lineitem", "l_orderkey")]
    return relational.Graph(tables, edges)


@query("""select c_custkey, round(sum(o_totalprice), 3) as customer__orders__o_totalprice__sum, round(avg(o_totalprice), 8) as customer__orders__o_totalprice__mean, count(o_orderkey) as customer__orders__count, n_name as customer__nation__n_name
 from customer left join orders on c_custkey = o_custkey left join nation on c_nationkey = n_nationkey group by c_custkey, n_name""")
def synthesis_depth1(spark, sf):
    df = relational.synthesize(_graph(spark, sf), "customer", ("sum", "mean", "count"), depth=1)
    df = df.withColumns({"customer__orders__o_totalprice__sum": F.round("customer__orders__o_totalprice__sum", 3), "customer__orders__o_totalprice__mean": F.round("customer__orders__o_totalprice__mean", 8)})
    return out(df, "c_custkey", "customer__orders__o_totalprice__sum", "customer__orders__o_totalprice__mean", "customer__orders__count", "customer__nation__n_name", digits=8)


@query("""with o as (select o_orderkey, o_custkey, sum(l_quantity) q from orders left join lineitem on o_orderkey = l_orderkey group by 1, 2)
select c_custkey, round(sum(q), 4) as "customer__orders__orders__lineitem__l_quantity__sum__sum" from customer left join o on c_custkey = o_custkey group by 1""")
def synthesis_depth2(spark, sf):
    df = relational.synthesize(_graph(spark, sf), "customer", ("sum",), depth=2, most=1000)
    return out(df, "c_custkey", "customer__orders__orders__lineitem__l_quantity__sum__sum", digits=4)


@query("""select c_custkey, count(l_quantity) as orders_lineitem_l_quantity_count, round(coalesce(sum(l_quantity), 0), 4)::double as orders_lineitem_l_quantity_sum, round(coalesce(max(l_quantity), 0), 4)::double as orders_lineitem_l_quantity_max
 from customer left join orders on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey group by 1""")
def cross_table(spark, sf):
    return out(relational.path_aggregate(_graph(spark, sf), ["customer", "orders", "lineitem"], ["l_quantity"], ("count", "sum", "max")), digits=4)


@query("""select x.relationship, x.orphans from (select 'region.r_regionkey->nation.n_regionkey' as relationship, (select count(*) from nation where n_regionkey not in (select r_regionkey from region)) as orphans
 union all select 'nation.n_nationkey->customer.c_nationkey', (select count(*) from customer where c_nationkey not in (select n_nationkey from nation))
 union all select 'customer.c_custkey->orders.o_custkey', (select count(*) from orders where o_custkey not in (select c_custkey from customer))
 union all select 'orders.o_orderkey->lineitem.l_orderkey', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))) x""")
def orphans(spark, sf):
    return out(_graph(spark, sf).orphans())


def _reference(edge):
    parent, pk, child, fk = edge
    return f"""select '{parent}' as parent, '{pk}' as parent_key, '{child}' as child, '{fk}' as child_key, confidence from
    (select avg(({fk} in (select {pk} from {parent}))::int)::double as confidence from (select distinct {fk} from {child} where {fk} is not null)), (select count(*) = count(distinct {pk}) as sole from {parent}) where sole and confidence >= 0.8"""


@query(" union all ".join(map(_reference, [("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey")])))
def detect_relationships(spark, sf):
    found = relational.detect({n: read(spark, sf, n) for n in ("region", "nation", "customer", "orders")})
    return spark.createDataFrame([(r.parent, r.parent_key, r.child, r.child_key, r.confidence) for r in found] or [("", "", "", "", 0.0)], "parent string, parent_key string, child string, child_key string, confidence double")


@query("""with p as (select user_id, ts, event_id, value from events where event_type = 'purchase')
select e.event_id, round(p.value, 6) as value_asof from (select * from events where event_type <> 'purchase') e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def as_of(spark, sf):
    e = read(spark, sf, "events")
    df = relational.as_of(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", ["value"])
    return out(df, "event_id", "value_asof")


@query("""select o_orderkey, 'changed' as change from orders where o_orderkey % 10 = 3 union all select o_orderkey, 'removed' from orders where o_orderkey % 10 = 7""")
def changes(spark, sf):
    old = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    new = old.where(F.col("o_orderkey") % 10 != 7).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, -1.0).otherwise(F.col("o_totalprice")))
    return relational.change_join(old, new, ["o_orderkey"])


# Profiles


def _num(c, t):
    return f"select '{c}' as \"column\", count(*) as rows, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min, round(max({c}), 4) as max, round(quantile_cont({c}, 0.5), 4) as p50, count(*) filter (where {c} = 0) as zeros, count(distinct {c}) as \"distinct\" from {t}"


@query(" union all ".join(_num(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def profile_numeric(spark, sf):
    df = profiling.profile_numeric(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out(df, "column", "rows", "n", "mean", "std", "min", "max", "p50", "zeros", "distinct", digits=4)


@query("""with c as (select lang, count(*) n from documents group by 1), t as (select sum(n) t from c) select count(*) as "distinct", round(max(n) / max(t), 6) as mode_share, round(sum(-(n / t) * ln(n / t)), 6) as entropy from c, t""")
def profile_categorical(spark, sf):
    return out(profiling.profile_categorical(read(spark, sf, "documents"), "lang"), "distinct", "mode_share", "entropy")


@query(r"""with t as (select length(text) n, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) w from documents) select round(avg(n), 4) as avg_length, min(n)::bigint as min_length, max(n)::bigint as max_length, round(avg(w), 4) as avg_words, max(w)::bigint as max_words from t""")
def profile_text(spark, sf):
    return out(profiling.profile_text(read(spark, sf, "documents"), "text"), digits=4)


@query("""select count(*) as rows, (count(*) - count(distinct (l_orderkey, l_linenumber)))::bigint as duplicates from lineitem""")
def duplicates(spark, sf):
    return out(profiling.duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("""with s as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::bigint as bin, count(*) as n from lineitem, s group by 1""")
def histogram(spark, sf):
    return out(profiling.histogram(read(spark, sf, "lineitem"), "l_extendedprice"), "bin", "n")


_LINE_REST = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _kind(c):
    truth = " or ".join(f"(lo in ({v}) and hi in ({v}))" for v in ("'true', 'false'", "'0', '1'", "'yes', 'no'", "'y', 'n'", "'t', 'f'"))
    return f"""select '{c}' as "column", case when n = 0 then 'unknown' when t in ('TIMESTAMP', 'DATE') or t = 'VARCHAR' and whens > 0.9 and nums <= 0.9 then 'datetime' when t = 'BOOLEAN' or d <= 2 and ({truth}) then 'boolean'
    when t in ('BIGINT', 'INTEGER', 'DOUBLE') or t = 'VARCHAR' and nums > 0.9 then 'numeric' when d > 50 and len > 50 then 'text' else 'categorical' end as kind
    from (select count({c}) n, count(distinct {c}) d, any_value(typeof({c})) t, avg((try_cast({c}::varchar as double) is not null)::int) nums, avg((try_cast({c}::varchar as timestamp) is not null)::int) whens, avg(length({c}::varchar)) len, min(lower({c}::varchar)) lo, max(lower({c}::varchar)) hi from lineitem)"""


@query(" union all ".join(map(_kind, [*LINE, *_LINE_REST])))
def inferred_types(spark, sf):
    found = profiling.infer_types(read(spark, sf, "lineitem"))
    return spark.createDataFrame(sorted(found.items()), "column string, kind string")


def _issues(c):
    many = f"""union all select '{c}', 'cardinality', d::double, 'low' from m where d > 2 and t = 'VARCHAR'"""
    return f"""select * from (with m as (select count(*) n, count(*) - count({c}) gone, count(distinct {c}) d, any_value(typeof({c})) t from lineitem)
    select '{c}' as "column", 'missing' as issue, (gone / n)::double as value, case when gone / n > 0.7 then 'high' else 'medium' end as severity from m where gone / n > 0.3 union all select '{c}', 'constant', 1.0, 'medium' from m where d <= 1 {many})"""


def _far(c):
    leak = "" if c == "l_extendedprice" else f"""union all select '{c}', 'leakage', round(r, 6), 'high' from (select corr({c}, l_extendedprice) r from lineitem) where abs(r) > 0.95"""
    return f"""select * from (select '{c}', 'outliers', round(x, 6), 'low' from (select avg((abs({c} - m) > 1.7 * s)::int) x from lineitem, (select avg({c}) m, stddev_samp({c}) s from lineitem)) where x > 0.01 {leak})"""


@query(" union all ".join([*map(_issues, [*LINE, *_LINE_REST]), *map(_far, [*LINE, *_LINE_REST[:4]])]))
def quality_issues(spark, sf):
    found = profiling.quality(read(spark, sf, "lineitem"), "l_extendedprice", z=1.7, many=2)
    return spark.createDataFrame([(i["column"], i["issue"], round(float(i["value"]), 6), i["severity"]) for i in found], "column string, issue string, value double, severity string")


def _broken(c):
    """Bounds of the cheaper orders that all orders break; half the range and
    one and a half deviations of the mean are allowed."""
    return f"""select * from (with a as (select min({c})::double lo, max({c})::double hi, avg({c}) m, stddev_samp({c}) s from orders where o_totalprice < 100000), b as (select min({c})::double lo, max({c})::double hi, avg({c}) m from orders)
    select '{c}' as "column", 'min_value' as "check", round(b.lo, 4) as value from a, b where b.lo < a.lo - (a.hi - a.lo) * 0.5
    union all select '{c}', 'max_value', round(b.hi, 4) from a, b where b.hi > a.hi + (a.hi - a.lo) * 0.5 union all select '{c}', 'mean_range', round(b.m, 4) from a, b where abs(b.m - a.m) > a.s * 1.5)"""


@query(" union all ".join(map(_broken, ["o_orderkey", "o_custkey", "o_totalprice"])))
def contract_violations(spark, sf):
    orders = read(spark, sf, "orders")
    c = profiling.make_contract(orders.where("o_totalprice < 100000"))
    found = profiling.check_contract(orders, profiling.Contract.from_json(c.to_json()))
    return spark.createDataFrame([(v["column"], v["check"], round(float(v["value"]), 4)) for v in found], "column string, check string, value double")


_PSI_E = "quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])"


@query(f"""with a as (select l_quantity v from lineitem where year(l_shipdate) < 1996), b as (select l_quantity v from lineitem where year(l_shipdate) >= 1996), q as (select list_sort(list_distinct({_PSI_E.replace('l_quantity', 'v')})) k from a), e as (select unnest(k) x from q),
 c as (select row_number() over (order by x) i, x lo, lead(x) over (order by x) hi, max(x) over () m from e), d as (select * from c where hi is not null),
 p as (select i, (select count(*) from a where v >= lo and (v < hi or (hi = m and v <= hi))) / (select count(*) from a) + 1e-6 p, (select count(*) from b where v >= lo and (v < hi or (hi = m and v <= hi))) / (select count(*) from b) + 1e-6 q from d)
select 'l_quantity' as "column", round(sum((q - p) * ln(q / p)), 6) as psi from p""")
def psi(spark, sf):
    df = read(spark, sf, "lineitem")
    return out(profiling.psi(df.where(F.year("l_shipdate") < 1996), df.where(F.year("l_shipdate") >= 1996), ["l_quantity"]))


@query("""with u as (select o_totalprice v, 1 a, 0 b from orders where o_orderkey % 2 = 0 union all select o_totalprice, 0, 1 from orders where o_orderkey % 2 = 1), c as (select v, sum(a) a, sum(b) b from u group by 1),
 r as (select sum(a) over (order by v) ca, sum(b) over (order by v) cb from c) select round(max(abs(ca / (select sum(a) from c) - cb / (select sum(b) from c))), 6) as statistic from r""")
def ks(spark, sf):
    o = read(spark, sf, "orders")
    return out(profiling.ks(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_totalprice"), "statistic")


@query("""select 'value' as "column", round(1 - count(value) / count(*), 6)::double as null_rate, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(distinct value) as cardinality from events""")
def observe(spark, sf):
    return out(profiling.observe(read(spark, sf, "events"), ["value"]), "column", "null_rate", "mean", "std", "cardinality")


@query("""with g as (select c_nationkey, c_mktsegment, count(*) n from customer group by 1, 2) select count(*) as groups, min(n) as smallest, count(*) filter (where n < 10) as groups_below, coalesce(sum(n) filter (where n < 10), 0)::bigint as rows_below from g""")
def k_anonymity(spark, sf):
    return out(profiling.k_anonymity(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 10))


@query("""select c_custkey, (case when count(*) over w >= 12 then c_nationkey else -1 end)::bigint as c_nationkey, case when count(*) over w >= 12 then c_mktsegment end as c_mktsegment from customer window w as (partition by c_nationkey, c_mktsegment)""")
def suppressed(spark, sf):
    df = profiling.suppress(read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 12)
    return out(df.fillna(-1, ["c_nationkey"]))


@query("""select round(avg(least(greatest(o_totalprice, 0), 200000)), 4) as private_mean from orders""")
def private_mean(spark, sf):
    df = read(spark, sf, "orders")
    return out(spark.createDataFrame([(profiling.private(df, "o_totalprice", "mean", 0.0, 200000.0, None),)], "private_mean double"), digits=4)


@query("""with j as (select * from documents join labels using (doc_id)), m as (select median(quality) md from j), g as (select lang, avg(quality) a, avg((quality > md)::int) s from j, m group by 1)
select round((max(a) - min(a)) / max(abs(a)), 6) as parity_gap, round(coalesce(case when max(s) = 0 then 0 else min(s) / max(s) end, 0), 6)::double as impact_ratio from g""")
def fairness(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return out(profiling.parity(df, "lang", "quality"))


@query("""with g as (select l_returnflag, corr(l_quantity, l_extendedprice) r from lineitem where l_returnflag is not null group by 1) select count(*) as groups, round(max(r) - min(r), 6) as odds_gap from g where r is not null and not isnan(r)""")
def equal_odds(spark, sf):
    return out(profiling.equal_odds(read(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"))


@query("""with b as (select min(c_nationkey)::double lo, (max(c_nationkey) - min(c_nationkey)) / 5.0::double w from customer), i as (select c_custkey, lo, w, least(greatest(ceil((c_nationkey - lo) / w), 1), 5) i from customer, b)
select c_custkey, printf('(%.2f, %.2f]', lo + (i - 1) * w, lo + i * w) as c_nationkey from i""")
def generalized(spark, sf):
    return out(profiling.generalize(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey"))


@query("""with b as (select regr_slope(c_acctbal, c_nationkey) s, regr_intercept(c_acctbal, c_nationkey) i from customer) select c_custkey, round(c_acctbal - (i + s * c_nationkey), 4) as c_acctbal_fair from customer, b""")
def residuals(spark, sf):
    return out(profiling.residualize(read(spark, sf, "customer"), "c_acctbal", "c_nationkey"), "c_custkey", "c_acctbal_fair", digits=4)


@query()
def experiment(spark, sf):
    df = profiling.variant(read(spark, sf, "orders"), "o_custkey", {"a": 0.5, "b": 0.5}, "s")
    return spark.createDataFrame([(r["variant"], r["difference"], r["t"], r["p"]) for r in profiling.compare_variants(df, "variant", "o_totalprice", "a")], "variant string, difference double, t double, p double")


_SIDE = "select '{c}' as \"column\", count(*) as rows_{k}, (count(*) - count({c}))::bigint as nulls_{k}, avg({c}) as mean_{k}, stddev_samp({c}) as std_{k}, min({c})::double as min_{k}, max({c})::double as max_{k} from orders where year(o_orderdate) {cond}"


def _compared(c):
    a, b = (_SIDE.format(c=c, k=k, cond=cond) for k, cond in (("before", "< 1996"), ("after", ">= 1996")))
    both = ", ".join(f"round({x}_{k}, 4) as {x}_{k}" for k in ("before", "after") for x in ("mean", "std", "min", "max"))
    return f"""select a."column", rows_before, nulls_before, rows_after, nulls_after, {both}, round(mean_after - mean_before, 4) as mean_change from ({a}) a, ({b}) b"""


@query(" union all ".join(map(_compared, ["o_orderkey", "o_custkey", "o_totalprice"])))
def compared_frames(spark, sf):
    orders = read(spark, sf, "orders")
    return out(monitoring.compare_frames(orders.where("year(o_orderdate) < 1996"), orders.where("year(o_orderdate) >= 1996")), digits=4)


@query("select count(*) as rows, count(*) filter (where v) as trues, count(*) filter (where not v) as falses, count(*) filter (where v is null) as nulls, round(avg(v::int), 6) as true_share from (select nullif(l_returnflag, 'N') = 'R' as v from lineitem)")
def profile_boolean(spark, sf):
    return out(monitoring.profile_boolean(read(spark, sf, "lineitem").select((F.nullif("l_returnflag", F.lit("N")) == "R").alias("v")), "v"))


@query("""with m as (select o_orderpriority as variant, avg(o_totalprice) as mean from orders group by 1), c as (select mean as base from m where variant = '1-URGENT')
select variant, 'o_totalprice' as metric, round(mean, 4) as mean, kind, bound from m, c, (values ('min', 252000.0::double), ('max', 255000.0::double), ('max_drop', 0.001::double)) as r(kind, bound)
where kind = 'min' and mean < bound or kind = 'max' and mean > bound or kind = 'max_drop' and variant <> '1-URGENT' and (base - mean) / abs(base) > bound""")
def guardrails(spark, sf):
    bounds = {"o_totalprice": {"min": 252_000, "max": 255_000, "max_drop": 0.001}}
    return out(monitoring.guardrails(read(spark, sf, "orders"), "o_orderpriority", bounds, "1-URGENT"), digits=4)


_PATHS = ["count", "mean", "sum", "min", "max", "std"]
_PATH_SQL = {"count": "count(l_discount)", "mean": "coalesce(avg(l_discount), 0)", "sum": "coalesce(sum(l_discount), 0)", "min": "coalesce(min(l_discount), 0)", "max": "coalesce(max(l_discount), 0)", "std": "coalesce(stddev_samp(l_discount), 0)"}


@query(f"select n_nationkey::bigint as n_nationkey, {', '.join(f'round({v}, 4)::double as customer_orders_lineitem_l_discount_{k}' if k != 'count' else f'{v} as customer_orders_lineitem_l_discount_count' for k, v in _PATH_SQL.items())} from nation left join customer on n_nationkey = c_nationkey left join orders on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey group by 1")
def path_of_four(spark, sf):
    """Along three joins, every aggregate, leaf first."""
    g = relational.Graph({n: read(spark, sf, n) for n in ("nation", "customer", "orders", "lineitem")}, [relational.Relationship("nation", "n_nationkey", "customer", "c_nationkey"), relational.Relationship("customer", "c_custkey", "orders", "o_custkey"), relational.Relationship("orders", "o_orderkey", "lineitem", "l_orderkey")])
    return out(relational.path_aggregate(g, ["nation", "customer", "orders", "lineitem"], ["l_discount"], _PATHS), digits=4)


@query("select event_id, round((rank() over (order by value) + (count(*) over (partition by value) - 1) / 2) / count(value) over (), 6) as value_rank from events where value is not null union all select event_id, null from events where value is null")
def percent_ranks_of_all(spark, sf):
    return out(temporal.percent_rank(read(spark, sf, "events"), "value"), "event_id", "value_rank")


# Selection

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scores(spark, s: selection.Selector) -> DataFrame:
    return out(spark.createDataFrame(sorted((c, float(v)) for c, v in s.scores.items()), "column string, score double"), digits=4)


@query(" union all ".join(f"select '{c}' as \"column\", round(var_samp({c}) / (avg({c}) * avg({c})), 4) as score from lineitem" for c in _NUM))
def variance(spark, sf):
    return _scores(spark, selection.Variance(_NUM).fit(read(spark, sf, "lineitem")))


@query(" union all ".join(f"select '{c}' as \"column\", round(max(n) / sum(n), 4)::double as score from (select {c}, count(*) n from lineitem group by 1)" for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def quasi_constant(spark, sf):
    return _scores(spark, selection.QuasiConstant(["l_returnflag", "l_linestatus", "l_linenumber"]).fit(read(spark, sf, "lineitem")))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def correlation(spark, sf):
    r = selection.correlations(read(spark, sf, "lineitem"), _NUM)
    return out(spark.createDataFrame([(a, b, x) for (a, b), x in r.items()], "a string, b string, r double"))


def _anova(c):
    return f"""select '{c}' as "column", round(((sum(n * (m - t) * (m - t)) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*)))), 4) as score from (select l_returnflag, count(*) n, avg({c}) m, var_pop({c}) * count(*) v from lineitem group by 1), (select avg({c}) t from lineitem)"""


@query(" union all ".join(map(_anova, _NUM)))
def anova(spark, sf):
    return _scores(spark, selection.Statistical(_NUM, "anova", k=2).fit(read(spark, sf, "lineitem"), "l_returnflag"))


def _chi2(c):
    return f"""select '{c}' as "column", round(sum((s - t * n / k) * (s - t * n / k) / (t * n / k)), 4) as score from (select l_returnflag, count(*) n, sum(abs({c})) s from lineitem group by 1), (select count(*) k, sum(abs({c})) t from lineitem)"""


@query(" union all ".join(map(_chi2, _NUM)))
def chi_square(spark, sf):
    return _scores(spark, selection.Statistical(_NUM, "chi2", k=2).fit(read(spark, sf, "lineitem"), "l_returnflag"))


_PAIRS = "select " + ", ".join(f"corr({_NUM[i]}, {_NUM[j]}) r{i}{j}" for i, j in itertools.combinations(range(4), 2)) + " from lineitem"


def _minor(without=None):
    """The determinant of the correlations, or of those without one column:
    inflation is the quotient of the two."""
    of = [i for i in range(4) if i != without]
    terms = []
    for p in itertools.permutations(of):
        odd = sum(p[i] > p[j] for i, j in itertools.combinations(range(len(p)), 2)) % 2
        terms.append(("- " if odd else "+ ") + " * ".join(["1.0", *[f"r{min(a, b)}{max(a, b)}" for a, b in zip(of, p, strict=True) if a != b]]))
    return f"(0.0 {' '.join(terms)})"


@query(" union all ".join(f"select '{c}' as \"column\", round({_minor(i)} / {_minor()}, 4) as score from ({_PAIRS})" for i, c in enumerate(_NUM)))
def inflation(spark, sf):
    return _scores(spark, selection.Multicollinearity(_NUM).fit(read(spark, sf, "lineitem")))


def _information(c):
    return f"""select * from (with q as (select list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) e from lineitem), x as (select len(list_filter(e, lambda t: {c} >= t)) b, l_returnflag y from lineitem, q where l_returnflag is not null),
    k as (select b, y, count(*) n from x group by all), w as (select n, sum(n) over (partition by b) pb, sum(n) over (partition by y) py, sum(n) over () t from k)
    select '{c}' as "column", round(sum(n / t * ln(n * t / (pb * py))), 4) as score from w)"""


@query(" union all ".join(map(_information, _NUM)))
def mutual_information(spark, sf):
    return _scores(spark, selection.Statistical(_NUM, "mutual_info", k=2).fit(read(spark, sf, "lineitem"), "l_returnflag"))


@query()
def forest_importance(spark, sf):
    return _scores(spark, selection.Importance(_NUM[:1] + _NUM[2:], trees=5).fit(read(spark, sf, "lineitem"), "l_extendedprice"))


@query()
def shapley(spark, sf):
    return _scores(spark, selection.Shapley(["l_quantity", "l_discount", "l_tax"], rounds=2, trees=5).fit(read(spark, sf, "lineitem"), "l_extendedprice"))


@query()
def stability(spark, sf):
    s = selection.Stability(lambda: selection.Statistical(None, "f_regression", k=2), ["l_quantity", "l_discount", "l_tax"], rounds=3)
    return _scores(spark, s.fit(read(spark, sf, "lineitem"), "l_extendedprice"))


@query()
def program_search(spark, sf):
    found = selection.search(read(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], rounds=2, width=20)
    return spark.createDataFrame(found, "program string, score double")


# Arrays and graphs


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings) select vec_id, round(list_avg(v), 5) as sig_embedding_mean, round(sqrt(greatest(list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) * list_avg(v), 0)), 5) as sig_embedding_std,
 round(list_max(v), 5) as sig_embedding_max, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 5) as sig_embedding_rms from e""")
def array_moments(spark, sf):
    df = arrays.Signal(["embedding"], spectral=False).fit_transform(read(spark, sf, "embeddings"))
    return out(df, "vec_id", "sig_embedding_mean", "sig_embedding_std", "sig_embedding_max", "sig_embedding_rms", digits=5)


@query()
def array_spectrum(spark, sf):
    df = arrays.Histogram(["embedding"]).fit_transform(arrays.Signal(["embedding"]).fit_transform(read(spark, sf, "embeddings")))
    return out(df.drop("embedding", "label"))


# Graphs: whoever trades with each other, over all lines. Customers, suppliers
# and parts of a line know each other, so every line is a triangle.


def _trades(spark, sf):
    """Every pair once. Nodes are numbers while they move: four times the key and
    its kind. The edges are made once and written to the shared folder."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c, s, p = (F.col(v).cast("long") * 4 + k for k, v in enumerate(("o_custkey", "l_suppkey", "l_partkey")))
    pairs = lines.select(F.inline(F.array(F.struct(c.alias("src"), s.alias("dst")), F.struct(c.alias("src"), p.alias("dst")), F.struct(s.alias("src"), p.alias("dst")))))
    one = graph.distinct(pairs.where("src is not null and dst is not null"), 3 * read(spark, sf, "lineitem").count())
    return graph.cut(one.withColumn("w", F.lit(1.0)))


def _trade(spark, sf):
    return graph.both_ways(_trades(spark, sf))


def _trader(node):
    """A node's name: c, s or p and its key."""
    node = F.col(node) if isinstance(node, str) else node
    kind = F.pmod(node, F.lit(4))
    return F.concat(F.element_at(F.array(F.lit("c"), F.lit("s"), F.lit("p")), (kind + 1).cast("int")), F.shiftright(node, 2))


def _named(df, *cols):
    return df.withColumns({c: _trader(c) for c in cols})


_T = """l as (select 'c' || o_custkey c, 's' || l_suppkey s, 'p' || l_partkey p from lineitem join orders on l_orderkey = o_orderkey),
 e as (select c s, s t from l union select c, p from l union select s, p from l), u as (select s, t from e union all select t, s from e), n as (select distinct s as node from u), k as (select s, count(*) k from u group by 1)"""
_TRI = f"""{_T}, o as (select case when (a.k, e.s) < (b.k, e.t) then e.s else e.t end x, case when (a.k, e.s) < (b.k, e.t) then e.t else e.s end y from e join k a on a.s = e.s join k b on b.s = e.t),
 w as (select p.x a, p.y b, q.y c from o p join o q on p.x = q.x and p.y < q.y join u on u.s = p.y and u.t = q.y), g as (select node, count(*) c from (select unnest([a, b, c]) node from w) group by 1)"""


@query("""with e as (select distinct 's' || l_suppkey s, 'p' || l_partkey t from lineitem where l_suppkey is not null and l_partkey is not null), b as (select s n from e union all select t from e)
select n as node, count(*) as degree, count(*) as in_degree from b group by 1""")
def graph_all_degrees(spark, sf):
    """Every supplier and part of all lines."""
    pairs = read(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("t")).distinct()
    return out(graph.degrees(graph.edges(pairs, "s", "t")), "node", "degree", "in_degree")


@query(f"with {_T} select s as node, k as degree, k as in_degree, k::double as weighted_degree from k")
def graph_degrees(spark, sf):
    return out(_named(graph.degrees(_trade(spark, sf)), "node"), "node", "degree", "in_degree", "weighted_degree")


@query(f"with {_TRI} select k.s as node, coalesce(c, 0)::bigint as triangles, round(case when k > 1 then 2 * coalesce(c, 0) / (k * (k - 1)) else 0 end, 6)::double as clustering from k left join g on g.node = k.s")
def graph_triangles(spark, sf):
    return out(_named(graph.triangles(_trades(spark, sf), once=True), "node"))


@query(f"with {_TRI} select k.s as node, (k + coalesce(c, 0))::bigint as ego_edges from k left join g on g.node = k.s")
def graph_ego_edges(spark, sf):
    return out(_named(graph.ego_edges(_trades(spark, sf), once=True), "node"))


_RANKED = "".join(
    f""", r{i + 1} as materialized (select n.node, 0.15 / (select count(*) from n) + 0.85 * coalesce(sum(r{i}.rank / k.k), 0) as rank from n left join u on u.t = n.node left join r{i} on r{i}.node = u.s left join k on k.s = u.s group by 1)"""
    for i in range(10)
)


@query(f"with {_T}, r0 as (select node, 1.0::double / (select count(*) from n) as rank from n){_RANKED} select node, round(rank, 9) as rank from r10")
def graph_pagerank(spark, sf):
    return out(_named(graph.pagerank(_trade(spark, sf), rounds=10), "node"), digits=9)


_SPREAD = "".join(
    f""", c{i + 1} as (select s as node, label from (select u.s, l{i}.label, row_number() over (partition by u.s order by count(*) desc, l{i}.label) as i from u join l{i} on l{i}.node = u.t group by 1, 2) where i = 1),
 l{i + 1} as materialized (select n.node, coalesce(c{i + 1}.label, l{i}.label) as label from n join l{i} using (node) left join c{i + 1} using (node))"""
    for i in range(3)
)


@query(f"with {_T}, l0 as (select node, node as label from n){_SPREAD} select node, label as community from l3")
def graph_communities(spark, sf):
    return _named(graph.communities(_trades(spark, sf), 3, _trader, mutual=True), "node", "community")


@query()
def graph_walks(spark, sf):
    return _named(graph.walks(_trades(spark, sf), 3, 6, name=_trader, mutual=True), "node", "at")


@query()
def graph_vectors(spark, sf):
    return _named(graph.node_vectors(_trades(spark, sf), 4, 3, 8, name=_trader, mutual=True), "node")


# Declared features

_SPEC = {"version": "1.0", "features": [
    {"name": "price_log", "transform": "log1p", "column": "l_extendedprice"}, {"name": "q_x_d", "transform": "multiply", "columns": ["l_quantity", "l_discount"]},
    {"name": "q_per_t", "transform": "divide", "columns": ["l_quantity", "l_tax"]}, {"name": "ship_month", "transform": "month", "column": "l_shipdate"},
    {"name": "flag_price", "transform": "target", "column": "l_returnflag", "target": "l_extendedprice"},
]}
_SPEC_SQL = f"""select {LKEY}, round(ln(1 + greatest(l_extendedprice, 0)), 6) as price_log, round(l_quantity * l_discount, 6) as q_x_d, round(l_quantity / nullif(l_tax, 0), 6) as q_per_t, month(l_shipdate)::bigint as ship_month,
 round((sum(l_extendedprice) over (partition by l_returnflag) + 10 * avg(l_extendedprice) over ()) / (count(*) over (partition by l_returnflag) + 10), 3) as flag_price from lineitem"""


def _declared(df):
    return out(df.withColumn("flag_price", F.round("flag_price", 3)), *LINE, "price_log", "q_x_d", "q_per_t", "ship_month", "flag_price")


@query(_SPEC_SQL)
def declared_columns(spark, sf):
    return _declared(dsl.apply(read(spark, sf, "lineitem"), dsl.parse(_SPEC)))


@query(_SPEC_SQL)
def declared_sql(spark, sf):
    return _declared(dsl.run_sql(spark, read(spark, sf, "lineitem"), dsl.parse(_SPEC), "declared_lines"))


@query()
def auto_features(spark, sf):
    return AutoFeatures("o_totalprice").fit_transform(_orders_customers(spark, sf).drop("o_orderkey", "c_name"))


# Streams (over what is there, against the batch)


@query("""select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as sum from events group by 1, 2""")
def tumbling_windows(spark, sf):
    df = stateful.tumbling(read(spark, sf, "events"), "ts", "value", "1 hour", ["event_type"])
    return out(df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "sum"), digits=4)


@query("""with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, round(sum(value), 4) as sum from s group by user_id, k""")
def session_windows(spark, sf):
    df = stateful.sessions(read(spark, sf, "events"), "ts", "value", "30 minutes", ["user_id"])
    return out(df.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "sum"), digits=4)


@query("""select user_id, count(value) as n, round(avg(value), 9) as mean, round(stddev_samp(value), 5) as std from events group by 1""")
def streamed_moments(spark, sf):
    rows = sketches.latest(_streamed(spark, sf, lambda df: stateful.running(df, "user_id", "value")), ["user_id"])
    return out(rows.select("user_id", "n", "mean", F.round("std", 5).alias("std")), digits=9)


def _streamed(spark, sf, made):
    """The table that a stream of the events leaves in the shared folder."""
    at = f"{io.shared_folder(spark)}/stream-{uuid.uuid4()}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return sketches.write_table(made(io.read_stream(spark, f"{sf}/events.parquet*", schema, 8)), f"{at}/table", f"{at}/checkpoint")


@query("""select user_id, strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as day, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from events where value is not null group by 1, 2""")
def streamed_day_quantiles(spark, sf):
    """Small groups: the sketch holds all values, so quantiles are exact."""
    table = _streamed(spark, sf, lambda df: sketches.quantiles(df, ["user_id"], "value", (0.5, 0.9), "ts", "1 day", "400 days", buckets=64))
    rows = sketches.latest(table, ["user_id", "window_start"])
    return out(rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90")))


@query("""select event_type, count(value) as n, 1::bigint as p50_near, 1::bigint as p90_near from events where value is not null group by 1""")
def streamed_quantiles(spark, sf):
    """Large groups: the sketch's quantiles have the wanted rank among all values, up to the bound of the sketch."""
    rows = sketches.latest(_streamed(spark, sf, lambda df: sketches.quantiles(df, ["event_type"], "value", (0.5, 0.9))), ["event_type"])
    bound = sketches.rank_error(sketches.MOST)
    both = read(spark, sf, "events").where("value is not null").join(F.broadcast(rows), "event_type")
    shares = both.groupBy("event_type", "n").agg(*[f(F.avg((F.col("value") < F.col("q")[k]).cast("double")), F.avg((F.col("value") <= F.col("q")[k]).cast("double"))) for k, f in enumerate([
        lambda low, high, p=p, name=name: ((low - bound <= p) & (high + bound >= p)).cast("long").alias(name) for p, name in ((0.5, "p50_near"), (0.9, "p90_near"))])])
    return out(shares)


@query("""with t as (select event_type, count(*) as t from events group by 1), c as (select event_type, user_id::varchar as item, count(*) as n from events group by 1, 2)
select event_type, item, n, 1::bigint as bounded from c join t using (event_type) where n > t / 41.0""")
def streamed_frequent(spark, sf):
    """Items that the sketch has to hold, with their exact counts and whether these are within its bounds."""
    rows = sketches.latest(_streamed(spark, sf, lambda df: sketches.frequent(df, ["event_type"], "user_id", most=40)), ["event_type"])
    events = read(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("item"))
    exact = events.groupBy("event_type", "item").agg(F.count("*").alias("n"))
    total = events.groupBy("event_type").agg(F.count("*").alias("t"))
    found = rows.join(exact, ["event_type", "item"]).join(total, "event_type").where(F.col("n") > F.col("t") / 41)
    return out(found.select("event_type", "item", "n", F.col("n").between(F.col("at_least"), F.col("at_most")).cast("long").alias("bounded")))


# Results that other queries show in part


_SPEARMAN = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_tax")]


@query(" union all ".join(f"""select '{a}' as a, '{b}' as b, round(corr(x, y), 6) as r from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from lineitem where {a} is not null and {b} is not null)""" for a, b in _SPEARMAN))
def rank_correlation(spark, sf):
    df = read(spark, sf, "lineitem")
    return out(spark.createDataFrame([(a, b, selection.rank_correlation(df, a, b)) for a, b in _SPEARMAN], "a string, b string, r double"))


@query("""select o_custkey as c_custkey, round(stddev_samp(o_totalprice), 4) as std, round(min(o_totalprice), 4) as min, round(max(o_totalprice), 4) as max, round(median(o_totalprice), 4) as median,
 case when count(*) > 2 then round(skewness(o_totalprice), 4) end as skew, count(distinct o_totalprice) as nunique from orders group by 1""")
def synthesis_moments(spark, sf):
    df = relational.synthesize(_graph(spark, sf), "customer", ("std", "min", "max", "median", "skew", "nunique"), depth=1, ignore=("o_orderkey",))
    names = ("std", "min", "max", "median", "skew", "nunique")
    df = df.where("customer__orders__o_totalprice__max is not null")
    return out(df.select("c_custkey", *[F.col(f"customer__orders__o_totalprice__{n}").alias(n) for n in names]), digits=4)


@query("""with c as (select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2), m as (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by n desc, o_orderpriority) i from c)
select o_custkey as c_custkey, max(case when i = 1 then o_orderpriority end) as mode, count(*) as nunique from m group by 1""")
def synthesis_modes(spark, sf):
    df = relational.synthesize(_graph(spark, sf), "customer", ("mode", "nunique"), depth=1)
    return out(df.where("customer__orders__o_orderpriority__mode is not null").select("c_custkey", F.col("customer__orders__o_orderpriority__mode").alias("mode"), F.col("customer__orders__o_orderpriority__nunique").alias("nunique")))


@query(" union all ".join(f"""select '{c}' as "column", round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.75), 4) as p75, round(sum(pow({c} - m, 3)) / count(*) / pow(sum(pow({c} - m, 2)) / count(*), 1.5), 4) as skew,
 round(sum(pow({c} - m, 4)) / count(*) / pow(sum(pow({c} - m, 2)) / count(*), 2) - 3, 4) as kurtosis, count(*) filter (where {c} < 0) as negatives from lineitem, (select avg({c}) m from lineitem)""" for c in _NUM))
def profile_shape(spark, sf):
    return out(profiling.profile_numeric(read(spark, sf, "lineitem"), _NUM), "column", "p25", "p75", "skew", "kurtosis", "negatives", digits=4)


@query("""with e as (select strftime(time_bucket(interval '1 hour', ts) - k * interval '1 hour', '%Y-%m-%d %H:%M') as start, event_type, value from events, (values (0), (1)) g(k))
select start, event_type, count(*) as n, round(sum(value), 4) as sum from e group by 1, 2""")
def sliding_windows(spark, sf):
    df = stateful.tumbling(read(spark, sf, "events"), "ts", "value", "2 hours", ["event_type"], slide="1 hour")
    return out(df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "sum"), digits=4)


_TAU = [("l_quantity", "l_discount"), ("l_discount", "l_tax"), ("l_quantity", "l_tax"), ("l_linenumber", "l_quantity")]


@query(" union all ".join(f"""select '{a}' as "left", '{b}' as "right", n, round((n * (n - 1) / 2 - tx - ty + txy - 2 * d) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 9) as tau from (
with c as (select {a} x, {b} y, count(*) k from lineitem where {a} is not null and {b} is not null group by 1, 2),
xs as (select x, sum(k) k from c group by 1), ys as (select y, sum(k) k from c group by 1)
select (select sum(k)::bigint from c) n, (select sum(k * (k - 1) / 2) from c) txy, (select sum(k * (k - 1) / 2) from xs) tx, (select sum(k * (k - 1) / 2) from ys) ty,
  (select sum(p.k::double * q.k) from c p join c q on p.x < q.x and p.y > q.y) d)""" for a, b in _TAU))
def rank_concordance(spark, sf):
    """Kendall's tau-b."""
    return out(concordance.kendall(read(spark, sf, "lineitem"), _TAU), digits=9)


@query("""with t as (select l_suppkey, l_extendedprice::double v, row_number() over (partition by l_suppkey order by v desc) r from (select distinct l_suppkey, l_extendedprice from lineitem where l_extendedprice is not null)),
m as (select l_suppkey, l_partkey v, row_number() over (partition by l_suppkey order by count(*) desc, l_partkey) r from lineitem where l_partkey is not null group by 1, 2)
select l_suppkey, round(any_value(top), 4) as l_suppkey_l_extendedprice_top3, round(exp(avg(ln(l_extendedprice))), 4) as l_suppkey_l_extendedprice_geomean, round(quantile_cont(l_extendedprice, 0.5), 4) as l_suppkey_l_extendedprice_median, any_value(m.v)::bigint as l_suppkey_l_partkey_mode
from lineitem join (select l_suppkey, sum(v) top from t where r <= 3 group by 1) using (l_suppkey) join m using (l_suppkey) where m.r = 1 group by 1""")
def own_aggregates(spark, sf):
    """Aggregates of the user's own, and medians and modes without a task that holds a group."""
    lines = read(spark, sf, "lineitem")
    prices = numeric.GroupStatistics("l_suppkey", ["l_extendedprice"], (aggregates.largest(3), "geomean", "median")).fit(lines).table
    parts = numeric.GroupStatistics("l_suppkey", ["l_partkey"], ("mode",)).fit(lines).table
    return out(prices.join(parts, "l_suppkey"), digits=4)


@query()
def seasonal_trends(spark, sf):
    """Season and trend by local regression of the orders' daily totals, by priority."""
    days = read(spark, sf, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    rows = loess.decompose_stl(days.withColumn("t", F.unix_date("day")), "total", 7, ["o_orderpriority"], ["t"], robust=True)
    return out(rows.select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), "total_trend", "total_seasonal", "total_residual", "total_seasonal_strength"), digits=4)


_HALVED = ["l_extendedprice", "l_discount", "l_quantity", "l_tax"]


@query("with p(program, r) as (" + " union all ".join(f"select '{op}({a},{b})', abs(corr({x}, l_extendedprice::double * l_discount * (1 + l_tax))) from lineitem" for a, b in itertools.combinations(_HALVED, 2) for op, x in (("multiply", f"{a}::double * {b}"), ("add", f"{a}::double + {b}"), ("subtract", f"{a}::double - {b}"))) + ") select program, round(r, 6) as score from p order by r desc limit 1")
def halved_programs(spark, sf):
    """The best of all pairs, by rounds over growing nested samples; the last round is over all rows."""
    trees = [(op, (a,), (b,)) for a, b in itertools.combinations(_HALVED, 2) for op in ("multiply", "add", "subtract")]
    lines = read(spark, sf, "lineitem").select(*LINE, *_HALVED, (F.col("l_extendedprice").cast("double") * F.col("l_discount") * (1 + F.col("l_tax"))).alias("saved"))
    programs = search.Programs(lines, "saved", _HALVED)
    return out(spark.createDataFrame(search.halving(programs, trees, keep=1), "program string, score double"))


_SOURCES = {
    "l_orderkey": ["l_orderkey"], "l_linenumber": ["l_linenumber"], "l_partkey": ["l_partkey"], "l_suppkey": ["l_suppkey"], "l_extendedprice_log1p": ["l_extendedprice"], "l_quantity_x_l_discount": ["l_quantity", "l_discount"],
    "l_extendedprice_wins": ["l_extendedprice"], "c_mktsegment_target": ["l_extendedprice"], "o_orderdate_month_sin": ["o_orderdate"],
}


@query(" union all ".join(f"""select '{f}' as feature, '{s}' as source, count({s}) as n from {dict(l="lineitem", o="orders", c="customer")[s[0]]}""" for f, ss in _SOURCES.items() for s in ss))
def feature_sources(spark, sf):
    """The columns that the flagship's features come from, read from its plan, and how many values each of these has."""
    store = lineage.Store(spark)
    store.add("now", flagship(spark, sf))
    counts = None
    for name in ("lineitem", "orders", "customer"):
        df = read(spark, sf, name)
        own = df.agg(*[F.count(c).alias(c) for c in df.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("n")) for c in df.columns])))
        counts = own if counts is None else counts.unionByName(own)
    return out(store.ancestors().join(counts, "source").select("feature", "source", "n"))


@query("""with o as (select o_totalprice::double v, ('0x' || right(md5('s' || coalesce(o_custkey::varchar, '')), 8))::bigint % 10000 < 5000 as a from orders),
g as (select a, avg(v) m, var_samp(v) s, count(v) n from o group by 1)
select 'b' as variant, round(b.m - c.m, 4) as difference, round((b.m - c.m) / sqrt(b.s / b.n + c.s / c.n), 6) as t from g b, g c where not b.a and c.a""")
def experiment_sides(spark, sf):
    """Welch's statistic of variants that a hash deals out."""
    df = profiling.variant(read(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double")), "o_custkey", {"a": 0.5, "b": 0.5}, "s")
    rows = [(r["variant"], round(r["difference"], 4), r["t"]) for r in profiling.compare_variants(df, "variant", "o_totalprice", "a")]
    return out(spark.createDataFrame(rows, "variant string, difference double, t double"))


@query("""with x as (select vec_id, unnest(embedding)::double v, unnest(range(len(embedding))) j, len(embedding) n from embeddings where len(embedding) > 1),
f as (select vec_id, n, k, sum(v * cos(2 * pi() * k * j / n)) re, sum(v * sin(2 * pi() * k * j / n)) im from x, range(513) t(k) where k <= n // 2 group by all),
p as (select vec_id, k / n as hz, k, re * re + im * im as w, sum(re * re + im * im) over (partition by vec_id) as t from f)
select vec_id, round(arg_max(hz, w) filter (where k > 0), 6) as peak, round(-sum(w / t * log2(w / t)) filter (where w > 0), 5) as entropy, round(sum(hz * w / t), 5) as centroid from p group by 1""")
def spectrum(spark, sf):
    df = arrays.Signal(["embedding"]).fit_transform(read(spark, sf, "embeddings").where(F.size("embedding") > 1))
    named = [F.round([F.col(c) for c in df.columns if c.endswith(f"_embedding_{k}")][0], d).alias(k) for k, d in (("peak", 6), ("entropy", 5), ("centroid", 5))]
    return out(df.select("vec_id", *named))


@query("""select event_id, round(case when count(value) over w > 2 then skewness(value) over w end, 4) as value_rolling_9_skew, round(case when count(value) over w > 3 then kurtosis(value) over w end, 4) as value_rolling_9_kurt
from events window w as (partition by user_id order by ts, event_id rows between 8 preceding and current row)""")
def rolling_shapes(spark, sf):
    return out(temporal.Rolling(["value"], (9,), ("skew", "kurt"), **_EV).fit_transform(read(spark, sf, "events")), "event_id", "value_rolling_9_skew", "value_rolling_9_kurt", digits=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
