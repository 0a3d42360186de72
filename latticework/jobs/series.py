"""Autocorrelation times and convergence of series: each user's events in order, and the same in SQL on lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.functions.hubs import with_hubs_apart
from latticework.functions.ranks import nearest_rank, numbered


def _chain():
    return Window.partitionBy("c")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c, i, x, n)``: the values of each chain, numbered from 1, and how many they are."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("c"), "ts", "event_id", F.col("value").alias("x"))
    order = F.row_number().over(_chain().orderBy("ts", "event_id"))
    return events.select("c", order.alias("i"), "x").withColumn("n", F.count(F.lit(1)).over(_chain()))


def _numbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c, i, x)`` as in ``_steps``, without a task that holds a whole chain."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("c"), "ts", "event_id", F.col("value").alias("x"))
    return numbered(events, ["c"], ["ts", "event_id"], "at").select("c", (F.col("at") + 1).alias("i"), "x")


def autocorrelation(steps: DataFrame, block: int = 1 << 14) -> DataFrame:
    """``(c, n, lag, rho)`` for lags up to the larger of 1 and a tenth of the chain ``steps(c, i, x)``, i from 1: biased, less the mean, over that of lag 0; without variance 0 but for lag 0.

    Chains are cut into blocks; a task correlates a block with itself or with one further on by a Fourier transform, and the sums of each lag are added up. So a block is sent to one task for
    each block that its longest lag reaches, and a task holds some two blocks or many short chains. A null value counts as the mean.
    """
    chains = steps.groupBy("c").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    total = steps.count()
    known = with_hubs_apart(steps, written(chains.withColumn("size", F.col("n"))), "c", "n", total).withColumnRenamed("size", "n")
    at = known.select("c", "n", F.expr(f"(i - 1) div {block}").alias("b"), F.expr(f"cast((i - 1) % {block} as int)").alias("at"), F.coalesce(F.col("x") - F.col("m"), F.lit(0.0)).alias("d"))
    own = written(at.groupBy("c", "n", "b").agg(F.sort_array(F.collect_list(F.struct("at", "d"))).getField("d").alias("d")))
    reach = F.expr(f"cast(greatest(1, n div 10) div {block} + 1 as int)")
    first = own.select("c", "n", "b", F.explode(F.sequence(F.lit(0), reach)).alias("k"), "d").withColumn("to", F.col("b") + F.col("k"))
    pairs = first.join(own.select("c", F.col("b").alias("to"), F.col("d").alias("e")), ["c", "to"])
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("c", "b", "k"), F.lit(max(1, total // (8 * block)))))

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, n, k, d, e in zip(rows["c"], rows["n"], rows["k"], rows["d"], rows["e"]):
            size = 1 << (len(d) + len(e)).bit_length()
            both = np.fft.irfft(np.conj(np.fft.rfft(d, size)) * np.fft.rfft(e, size), size)
            lags = np.arange(1 - len(d), len(e))
            lag = lags + int(k) * block
            good = (lag >= 0) & (lag <= max(1, n // 10)) & (lag < n)
            out.append(pd.DataFrame({"c": c, "n": n, "lag": lag[good], "s": both[lags[good]]}))
        return pd.concat(out)

    kind = dict(steps.dtypes)["c"]
    sums = pairs.groupBy("task").applyInPandas(correlate, f"c {kind}, n long, lag long, s double")
    g = written(sums.groupBy("c", "n", "lag").agg((F.sum("s") / F.col("n")).alias("g")))
    rho = F.when(F.col("lag") == 0, 1.0).when(F.abs("g0") < 1e-6, 0.0).otherwise(F.col("g") / F.col("g0"))
    zero = g.where("lag = 0").select("c", F.col("g").alias("g0"))
    return g.join(zero, "c").select("c", "n", F.col("lag").cast("int").alias("lag"), rho.alias("rho"))


def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autocorrelation(_numbered_steps(spark, sf_dir)).select("c", F.col("lag").cast("long").alias("lag"), F.round("rho", 9).alias("rho"))


def sokal_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window of at least five times its own integrated time, else the last."""
    acf = autocorrelation(_numbered_steps(spark, sf_dir))
    total = F.sum(F.when(F.col("lag") > 0, F.col("rho")).otherwise(0.0)).over(_chain().orderBy("lag"))
    taus = acf.select("c", "lag", F.greatest(F.lit(1.0), 1 + 2 * total).alias("tau"))
    enough = F.when((F.col("lag") > 0) & (F.col("lag") >= 5 * F.col("tau")), F.col("lag"))
    best = taus.groupBy("c").agg(F.min_by("tau", enough).alias("tau"), F.min(enough).alias("m"), F.max_by("tau", "lag").alias("last"), F.max("lag").alias("most"))
    return best.select("c", F.round(F.coalesce("tau", "last"), 8).alias("tau"), F.coalesce("m", "most").cast("long").alias("window_m"))


def geyer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The initial positive sequence: pair sums, never rising, up to the first that isn't positive; the first pair counts without lag 0."""
    acf = autocorrelation(_numbered_steps(spark, sf_dir))
    pairs = acf.groupBy("c", "n", F.expr("lag div 2").alias("k")).agg(F.sum("rho").alias("gamma"), F.count(F.lit(1)).alias("both"), F.max_by("rho", "lag").alias("odd"))
    pairs = pairs.withColumn("least", F.when(F.col("both") == 2, F.min("gamma").over(_chain().orderBy("k"))))
    first = F.sum(F.when((F.col("k") == 0) & (F.col("both") == 2), F.col("odd")))
    rest = F.sum(F.when((F.col("k") > 0) & (F.col("least") > 0), F.col("least")))
    out = pairs.groupBy("c", "n").agg(F.coalesce(first, F.lit(0.0)).alias("s1"), F.coalesce(rest, F.lit(0.0)).alias("s2"), F.coalesce(F.max(F.when(F.col("least") > 0, F.col("k"))), F.lit(0)).alias("last"))
    window = F.when(F.col("n") > 1, F.least(F.expr("greatest(1, n div 10)"), 2 * F.col("last") + 1)).otherwise(0)
    return out.select("c", F.round(F.greatest(F.lit(1.0), 1 + 2 * (F.col("s1") + F.col("s2"))), 8).alias("tau"), window.cast("long").alias("window_m"))


def moving_average_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step whose mean of the last 50 (or all, of fewer) values is within 1 % of the median of the last tenth of such means; else the last step."""
    steps = _steps(spark, sf_dir).withColumn("w", F.least(F.lit(50), "n"))
    order = _chain().orderBy("i")
    mean = F.when(F.col("n") >= 50, F.avg("x").over(order.rowsBetween(-49, 0))).otherwise(F.avg("x").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    smooth = steps.withColumn("mean", mean).where("i >= w").withColumn("tail", F.expr("least(n - w + 1, greatest(5, ceil((n - w + 1) * 0.1D)))"))
    ref = F.median(F.when(F.col("i") > F.col("n") - F.col("tail"), F.col("mean"))).over(_chain())
    marked = smooth.withColumn("ref", ref).withColumn("near", F.abs(F.col("mean") - F.col("ref")) <= F.greatest(F.lit(1e-12), 0.01 * F.greatest(F.lit(1.0), F.abs("ref"))))
    out = marked.groupBy("c").agg(F.coalesce(F.min(F.when(F.col("near"), F.col("i"))), F.max("n")).alias("first_i"), F.round(F.max("ref"), 6).alias("tail_reference"))
    return out.select("c", F.col("first_i").cast("long").alias("first_i"), "tail_reference")


def lower_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of rank floor(0.9 * (n - 1)) of each type's events and of each flag's prices."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("k"), F.col("value").alias("v"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"))
    return nearest_rank(events.unionByName(lines), ["k"], "v", 0.9)


QUERIES = {"lower_quantiles": lower_quantiles, "acf_lags": acf_lags, "sokal_tau": sokal_tau, "geyer_pairs": geyer_pairs, "moving_average_convergence": moving_average_convergence}

_LISTS = """with s as (select user_id as c, list(value order by ts, event_id) as x, count(*) as n from events group by user_id),
 d as (select c, n, [v - list_avg(x) for v in x] as d from s),
 g as (select c, n, [list_sum([d[i] * d[i + k] for i in range(1, n - k + 1)]) / n for k in range(0, least(n - 1, greatest(1, n // 10)) + 1)] as g from d),
 r as (select c, n, len(g) - 1 as cap, list_transform(g, lambda v, p: case when p = 1 then 1.0 when abs(g[1]) < 1e-6 then 0.0 else v / g[1] end) as rho from g)"""
ORACLES = {
    "lower_quantiles": """with v as (select event_type as k, value as v from events where value is not null union all select l_returnflag, l_extendedprice from lineitem where l_extendedprice is not null),
        r as (select k, v, row_number() over (partition by k order by v) - 1 as place, count(*) over (partition by k) as n from v) select k, v as quantile, n from r where place = cast(floor(0.9::double * (n - 1)) as bigint)""",
    "acf_lags": _LISTS + " select c, unnest(range(0, cap + 1)) as lag, round(unnest(rho), 9) as rho from r",
    "sokal_tau": _LISTS + """, t as (select c, cap, [greatest(1.0, 1 + 2 * coalesce(list_sum(rho[2:m + 1]), 0)) for m in range(1, cap + 1)] as tau from r),
        f as (select c, cap, tau, list_filter(range(1, cap + 1), lambda m: m >= 5 * tau[m])[1] as m from t)
        select c, round(coalesce(tau[coalesce(m, cap)], 1.0), 8) as tau, coalesce(m, cap) as window_m from f""",
    "geyer_pairs": _LISTS + """, p as (select c, cap, rho, [rho[2 * k + 1] + rho[2 * k + 2] for k in range(0, (cap + 1) // 2)] as gamma from r),
        q as (select c, cap, rho, list_filter([list_min(gamma[1:k]) for k in range(1, len(gamma) + 1)], lambda v: v > 0) as least from p)
        select c, round(greatest(1.0, 1 + 2 * (case when cap > 0 then rho[2] else 0 end + coalesce(list_sum(least[2:]), 0))), 8) as tau,
         case when cap = 0 then 0 else least(cap, 2 * greatest(len(least) - 1, 0) + 1) end as window_m from q""",
    "moving_average_convergence": """with s as (select user_id as c, list(value order by ts, event_id) as x, count(*) as n, least(50, count(*)) as w from events group by user_id),
        m as (select c, n, w, [list_avg(x[j - w + 1:j]) for j in range(w, n + 1)] as mean from s),
        t as (select c, n, w, mean, list_aggregate(mean[len(mean) - least(len(mean), greatest(5, cast(ceil(len(mean) * 0.1::double) as bigint))) + 1:], 'median') as ref from m)
        select c, coalesce(list_filter(range(1, len(mean) + 1), lambda j: abs(mean[j] - ref) <= greatest(1e-12, 0.01::double * greatest(1.0, abs(ref))))[1] + w - 1, n) as first_i, round(ref, 6) as tail_reference from t""",
}
