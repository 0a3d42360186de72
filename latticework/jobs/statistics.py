"""Ensemble statistics as DataFrame code; ``statistics_sql.py`` has the same as SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = ("f", "t")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int, name: str) -> Column:
    return F.round(c, digits).alias(name)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal values m of each disorder sample s at a grid point (f, t)."""
    m = (F.col("l_discount") - 0.05) / 0.05
    return _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("t"), F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("k"), m.alias("m"))


def thermal(table: DataFrame) -> DataFrame:
    """Thermal means by sample; ``last`` is the largest number of a value, which stands for the volume."""
    return table.groupBy(*POINT, "s").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("m1"), F.avg(F.abs("m")).alias("a1"), F.avg(F.col("m") ** 2).alias("m2"), F.avg(F.col("m") ** 3).alias("m3"), F.avg(F.abs("m") ** 3).alias("a3"), F.avg(F.col("m") ** 4).alias("m4"), F.max("k").alias("last"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observable p of size l at density rho_key."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    both = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return both.select(F.col("c_nationkey").alias("l"), F.floor(F.col("o_totalprice") / 10000).alias("rho_key"), F.col("o_totalprice").alias("p"))


def points(table: DataFrame) -> DataFrame:
    return table.groupBy("l", "rho_key").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p1"), F.var_pop("p").alias("v"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    return values(spark, sf_dir).groupBy(*POINT).agg(F.count(m).alias("n"), _r(F.avg(m), 9, "m1"), _r(F.avg(F.abs(m)), 9, "abs1"), _r(F.avg(m**2), 9, "m2"), _r(F.avg(m**4), 9, "m4"), _r(F.stddev_pop(m), 9, "sd"))


def two_level_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal moments within each sample, then their averages over the samples."""
    mean = {"dis_m": F.col("m1"), "dis_abs": F.col("a1"), "dis_m2": F.col("m2"), "dis_m3": F.col("m3"), "dis_abs3": F.col("a3"), "dis_m4": F.col("m4"), "q_ea": F.col("m1") ** 2, "dis_abs_sq": F.col("a1") ** 2, "dis_m_p4": F.col("m1") ** 4, "dis_abs_p4": F.col("a1") ** 4, "dis_m2_sq": F.col("m2") ** 2}
    return thermal(values(spark, sf_dir)).groupBy(*POINT).agg(F.count(F.lit(1)).alias("samples"), *[_r(F.avg(c), 9, name) for name, c in mean.items()])


def susceptibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal, disorder and total susceptibility of |m| and of m, times the volume; the total is the sum of the two."""
    d = thermal(values(spark, sf_dir)).groupBy(*POINT).agg(F.max("last").alias("v"), F.avg("m2").alias("x2"), *[F.avg(F.col(c)).alias(c) for c in ("a1", "m1")], *[F.avg(F.col(c) ** 2).alias(c + "sq") for c in ("a1", "m1")])
    v, out = F.col("v"), []
    for c, name in (("a1", "abs"), ("m1", "m")):
        th, dis = v * (F.col("x2") - F.col(c + "sq")), v * (F.col(c + "sq") - F.col(c) ** 2)
        out += [_r(th, 8, f"chi_th_{name}"), _r(dis, 8, f"chi_dis_{name}"), _r(th + dis, 8, f"chi_tot_{name}")]
    return d.select(*POINT, *out)


def _binder(fourth: str, second: str, name: str) -> Column:
    return _r(F.when(F.col(second) > 1e-15, 1 - F.col(fourth) / (3 * F.col(second) ** 2)).otherwise(0.0), 9, name)


def binder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulants of the thermal moments and of the samples' thermal means; U22 is the spread of the second moment."""
    d = thermal(values(spark, sf_dir)).groupBy(*POINT).agg(F.avg("m2").alias("x2"), F.avg("m4").alias("x4"), F.avg(F.col("m1") ** 2).alias("q"), F.avg(F.col("m1") ** 4).alias("q4"), F.avg(F.col("a1") ** 2).alias("b"), F.avg(F.col("a1") ** 4).alias("b4"), F.avg(F.col("m2") ** 2).alias("x22"))
    return d.select(*POINT, _binder("x4", "x2", "u4"), _binder("q4", "q", "u_ea"), _binder("b4", "b", "u_ea_abs"), _binder("x22", "x2", "u22"))


def jackknife_chi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out error of the total susceptibility of |m|, from totals; 0 of one sample."""
    own = thermal(values(spark, sf_dir)).select(*POINT, "s", "a1", "m2")
    totals = own.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), F.sum("a1").alias("s1"), F.sum("m2").alias("s2"))
    left = own.join(totals, list(POINT))
    th = F.try_divide(F.col("s2") - F.col("m2"), F.col("n") - 1) - F.try_divide(F.col("s1") - F.col("a1"), F.col("n") - 1) ** 2
    sums = left.select(*POINT, "n", th.alias("th")).groupBy(*POINT).agg(F.max("n").alias("n"), F.var_pop("th").alias("v"))  # partial sums, no window over all samples
    return sums.select(*POINT, "n", _r(F.coalesce(F.sqrt(F.col("v") * (F.col("n") - 1)), F.lit(0.0)), 10, "sem"))


def peak_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of the largest variance of each size, the lower one of equals."""
    own = points(grid(spark, sf_dir)).where("n > 1")
    return own.groupBy("l").agg(F.min_by("rho_key", F.struct(-F.round("v", 4), "rho_key")).alias("peak"))


def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(grid(spark, sf_dir)).groupBy("l").agg(F.min_by("rho_key", F.struct(F.abs(F.col("rho_key") - 17), "rho_key")).alias("rho_key"))


def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = grid(spark, sf_dir).where(F.col("rho_key").between(10, 20) & (F.col("l") % 2 == 0))  # before the grouping
    return points(own).select("l", "rho_key", "n", _r("p1", 6, "p1"))


def loglog_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(grid(spark, sf_dir)).groupBy("l").agg(F.regr_slope(F.log("n"), F.log(F.col("rho_key") + 1)).alias("slope"))
    return own.select("l", _r(F.coalesce("slope", F.lit(0.0)), 6, "slope"))


def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the line 10,000 rho + 5,000; the total sum of squares is n times the variance, so one pass is enough."""
    own = grid(spark, sf_dir).withColumn("r", F.col("p") - (F.col("rho_key") * 10000 + 5000))
    sums = own.groupBy("l").agg(F.avg(F.col("r") ** 2).alias("e"), F.var_pop("p").alias("v"))
    return sums.select("l", _r(F.sqrt("e"), 6, "rmse"), _r(F.when(F.col("v") > 0, 1 - F.col("e") / F.col("v")), 9, "r2"))


def sem_from_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = grid(spark, sf_dir).groupBy("l", "rho_key").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("a"), F.avg(F.col("p") ** 2).alias("b"))
    return sums.select("l", "rho_key", _r(F.sqrt(F.greatest(F.col("b") - F.col("a") ** 2, F.lit(0.0)) / F.col("n")), 4, "sem"))


def step_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(grid(spark, sf_dir)).withColumn("d", F.col("rho_key") - F.lag("rho_key").over(Window.partitionBy("l").orderBy("rho_key")))
    return own.where("d is not null").groupBy("l").agg(F.median("d").alias("step"))


def collapse_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled axes of a collapse with centre 17 and exponents 1.25 and 0.125, sizes over the largest, 25."""
    scale = (F.col("l") + 1) / 25.0
    return points(grid(spark, sf_dir)).select("l", "rho_key", _r((F.col("rho_key") - 17.0) * scale**1.25, 8, "x"), _r(F.col("p1") * scale**0.125, 4, "y"))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _read(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_custkey", "left_anti")


def histogram_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    return own.groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("how_many"))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda status, odd: F.count_if((F.col("l_linestatus") == status) & (F.col("l_linenumber") % 2 == odd))
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(one("O", 0).alias("o_even"), one("O", 1).alias("o_odd"), one("F", 0).alias("f_even"), one("F", 1).alias("f_odd"))


def ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("q"))
    both = own.join(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return both.groupBy(F.col("s_nationkey").alias("nation")).agg(_r(F.avg("q"), 9, "mean"), _r(F.coalesce(F.stddev_samp("q"), F.lit(0.0)), 9, "sd1"), _r(F.stddev_pop("q"), 9, "sd0"))


def overlap_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both bitmaps of an order in one grouping, so that no join is needed."""
    bit = F.expr("shiftleft(1L, cast(l_linenumber as int))")
    zero = F.lit(0).cast("long")
    own = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s")).agg(F.bit_or(F.when(F.col("l_returnflag") == "N", bit).otherwise(zero)).alias("a"), F.bit_or(F.when(F.col("l_linestatus") == "O", bit).otherwise(zero)).alias("b"))
    both, of_b = F.bit_count(F.col("a").bitwiseAND(F.col("b"))), F.bit_count("b")
    return own.select("s", both.alias("both_set"), of_b.alias("of_b"), _r(F.coalesce(F.try_divide(both, of_b), F.lit(0.0)), 9, "overlap"))


def asof_tolerance(spark: SparkSession, sf_dir: str, tolerance: int = 5000) -> DataFrame:
    """The nearest order of each event's user within ``tolerance``, the least key of equals.

    An equi-join on user and cell of the width of the tolerance: each event looks into its own cell and the two beside it.
    """
    x, y = F.floor(F.col("value") * 1000), F.floor("o_totalprice")
    events = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c"), x.alias("x"))
    events = events.withColumn("cell", F.explode(F.array(*[F.floor(F.col("x") / tolerance) + i for i in (-1, 0, 1)])))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), y.alias("y"), F.floor(y / tolerance).alias("cell"))
    near = events.join(orders, ["c", "cell"]).withColumn("gap", F.abs(F.col("x") - F.col("y"))).where(F.col("gap") <= tolerance)
    return near.groupBy("event_id").agg(F.min(F.struct("gap", "o_orderkey")).alias("best")).select("event_id", "best.o_orderkey", "best.gap")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (moments, two_level_average, susceptibility, binder, jackknife_chi, peak_rho, nearest_point, window_filter, loglog_slope, fit_quality, sem_from_moments, step_median, collapse_frame, resume_antijoin, histogram_nonzero, type_counts, ratio_stats, overlap_popcount, asof_tolerance)
}
