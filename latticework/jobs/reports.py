"""Reports over samples (quantiles, portions, order parameters, resampling) and rules on other lattices and borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.jobs.inputs import POISSON, lattices
from latticework.jobs.statistics import grid, points, thermal, values
from latticework.operators import lattice


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type: the interpolated percentile at 0.95, of counts of values, and the ends."""
    e = _read(spark, sf_dir, "events").where(F.col("value").isNotNull())
    own = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.95).alias("p"), F.min("value").alias("least"), F.max("value").alias("most"))
    return own.select("event_type", "n", F.round("p", 9).alias("p95"), "least", "most")


def ensemble_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by number of lines as clusters by size, a dense bin a size, with the portion of lines in them."""
    sizes = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    bins = sizes.agg(F.max("size").alias("most"), F.sum(F.col("size") * F.col("n")).alias("sites"))
    dense = bins.select("sites", F.explode(F.expr("sequence(1L, most)")).alias("size"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return dense.join(sizes, "size", "left").select("size", n.alias("n"), F.round(F.col("size") * n / F.col("sites"), 9).alias("portion"))


def order_parameter(spark: SparkSession, sf_dir: str, states: int = 9) -> DataFrame:
    """Fractions of each of ``states`` spins by point; the largest difference of two, absent states counting as 0."""
    counts = values(spark, sf_dir).groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("k") == q).alias(f"c{q}") for q in range(1, states + 1)])
    all_ = [F.col(f"c{q}") for q in range(1, states + 1)]
    return counts.select("f", "t", F.round((F.greatest(*all_) - F.least(*all_)) / F.col("n"), 9).alias("m"), F.round(F.col("c1") / F.col("n"), 9).alias("first"))


def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of set less those of unset sites, over all weights."""
    li = _read(spark, sf_dir, "lineitem")
    w = F.col("l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("g")).agg(F.round(F.sum(F.when(F.col("l_linestatus") == "O", w).otherwise(-w)) / F.sum(w), 9).alias("r"))


def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct densities and the smallest and largest sample of each size."""
    return points(grid(spark, sf_dir)).groupBy("l").agg(F.count_distinct("rho_key").alias("densities"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n"))


def zero_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sample's responses, the shares that are zero, non-zero on an occupied and non-zero on an empty site; mean and deviation of the changes; then mean and deviation over the samples."""
    li = _read(spark, sf_dir, "lineitem")
    zero, one = F.col("l_discount") < 0.005, F.col("l_linestatus") == "O"
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    sd = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 9)
    own = li.groupBy("l_suppkey").agg(share(zero).alias("a"), share(~zero & one).alias("b"), share(~zero & ~one).alias("c"), F.avg("l_quantity").alias("d"), F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)).alias("e"))
    return own.agg(*[x for c in "abcde" for x in (F.round(F.avg(c), 9).alias(f"mean_{c}"), sd(c).alias(f"sd_{c}"))])


def bootstrap_sem(spark: SparkSession, sf_dir: str, draws: int = 20) -> DataFrame:
    """Mean and standard error of each resampling of the samples' |m| by point, and chi_dis; a sample is drawn Poisson(1) times by a hash."""
    own = thermal(values(spark, sf_dir)).select("f", "t", "s", "a1", "last")
    rep = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = lattice.uniform(F.col("rep"), F.col("s")) / F.lit(float(2**32))
    rep = rep.withColumn("w", sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0)))
    sums = rep.groupBy("f", "t", "rep").agg(F.sum("w").alias("drawn"), F.sum(F.col("w") * F.col("a1")).alias("x"), F.sum(F.col("w") * F.col("a1") ** 2).alias("y"), F.max("last").alias("v"))
    mean, second = F.try_divide("x", "drawn"), F.try_divide("y", "drawn")
    spread = F.greatest(second - mean**2, F.lit(0.0))
    return sums.select("f", "t", "rep", "drawn", F.round(mean, 9).alias("mean"), F.round(F.sqrt(F.try_divide(spread, "drawn")), 9).alias("sem"), F.round(F.col("v") * spread, 8).alias("chi_dis"))


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and differences of two key sets, and the keys that are wanted but missing."""
    a = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = _read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = a.unionByName(b).where("k is not null").groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))  # one shuffle for all four
    return both.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.expr("a = 1 and b = 1")).alias("n_both"), F.count_if(F.expr("a = 1 and b = 0")).alias("n_first"), F.count_if(F.expr("a = 0 and b = 1")).alias("missing"))


def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial of least error with a positive exponent in each group; of all trials where none is positive."""
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), F.struct(F.col("l_extendedprice").alias("rmse"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i")).alias("x"), (F.col("l_quantity") - 45).alias("c"))
    best = li.groupBy("g").agg(F.coalesce(F.min(F.when(F.col("c") > 0, F.col("x"))), F.min("x")).alias("x"))
    return best.select("g", "x.rmse", "x.o", "x.i")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each point's canonical JSON, keys in order and numbers to five digits."""
    own = points(grid(spark, sf_dir))
    key = F.concat(F.lit('{"L":'), F.col("l").cast("string"), F.lit(',"rho":"'), F.format_string("%.5f", F.col("rho_key") / 100), F.lit('"}'))
    return own.select("l", "rho_key", F.sha2(key, 256).alias("signature"))


def valid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of finite positive values, of others, and sweeps that they ask for: fifty times, 20 at least and 10,000 at most."""
    v = F.col("c_acctbal") / 10
    good = F.coalesce((v > 0) & (v < float("inf")), F.lit(False))
    sweeps = F.when(good, F.least(F.lit(10000), F.greatest(F.lit(20), F.ceil(50 * v)))).otherwise(10000).cast("long")
    return _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.round(F.avg(sweeps), 9).alias("mean_sweeps"), F.round(F.stddev_pop(sweeps), 9).alias("sd_sweeps"), F.count_if(good & (v > 100)).alias("warned"))


def _occupied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    table, length = lattices(spark, sf_dir)
    return written(table), length


def _neighbours_set(table: DataFrame, at: Column, name: str) -> DataFrame:
    """``table`` with the number of its set sites that list it in ``at`` (set sites send themselves on)."""
    sent = table.where("occ = 1").select("sample_id", F.explode(F.array_distinct(at)).alias("site")).groupBy("sample_id", "site").agg(F.count(F.lit(1)).alias(name))
    return table.join(sent, ["sample_id", "site"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def hexagonal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of occupied neighbours on the periodic lattice of degree six, rows in turn shifted by half a site."""
    table, n = _occupied(spark, sf_dir)
    at = lambda x, y: F.expr(f"pmod({y}, {n}) * {n} + pmod({x}, {n})")
    side = "x - 1 + 2 * (y % 2)"
    six = F.array(at("x + 1", "y"), at("x - 1", "y"), at("x", "y + 1"), at("x", "y - 1"), at(side, "y + 1"), at(side, "y - 1"))
    return _neighbours_set(table, six, "k").groupBy("sample_id", "occ", "k").agg(F.count(F.lit(1)).alias("n"))


def blocked_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by state: occupied with an occupied neighbour (blocked, 1), their rim (2), others that remain (0); and isolated occupied ones."""
    table, n = _occupied(spark, sf_dir)
    ruled = lattice.local_rules(table, n)
    state = F.expr("case when core = 1 then 1 when n_core > 0 then 2 else 0 end")
    return ruled.groupBy("sample_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("occ = 1 and n_occ = 0")).alias("isolated"))


def open_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied neighbours inside open borders, border sites of even parity cleared first; by distance from the border, up to 3."""
    table, n = _occupied(spark, sf_dir)
    border = f"(x = 0 or y = 0 or x = {n - 1} or y = {n - 1})"
    table = table.withColumn("occ", F.expr(f"case when {border} and (x + y) % 2 = 0 then 0 else occ end"))
    steps = F.filter(F.array(*[F.when(F.expr(inside), F.expr(to)) for inside, to in ((f"x < {n - 1}", "site + 1"), ("x > 0", "site - 1"), (f"y < {n - 1}", f"site + {n}"), ("y > 0", f"site - {n}"))]), lambda v: v.isNotNull())
    ring = F.expr(f"least(3, x, y, {n - 1} - x, {n - 1} - y)")
    return _neighbours_set(table, steps, "k").groupBy("sample_id", ring.cast("long").alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("n_occ"), F.sum("k").alias("bonds"))


def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied sites and those of their 2-core, by sample."""
    table, n = _occupied(spark, sf_dir)
    core = lattice.k_core(table.where("occ = 1").select("sample_id", "site", "x", "y"), n, 2)
    kept = core.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_core"), F.sum("site").alias("sites"))
    zero = F.lit(0).cast("long")
    return table.groupBy("sample_id").agg(F.sum("occ").alias("n_occ")).join(kept, "sample_id", "left").select("sample_id", "n_occ", F.coalesce("n_core", zero).alias("n_core"), F.coalesce("sites", zero).alias("sites"))


QUERIES = {q.__name__: q for q in (quantiles, ensemble_bins, order_parameter, imbalance, size_statistics, zero_ratios, bootstrap_sem, key_sets, best_trial, signatures, valid_times, hexagonal_neighbours, blocked_sites, open_borders, k_core)}


def oracles(sites: str, hashed: str, drawn: str) -> dict[str, str]:
    """SQL for an independent engine, given its lattice, its hash and its weights."""
    from latticework.jobs.statistics_sql import POINTS, THERMAL

    named = lambda text: text.replace("{lineitem}", "lineitem").replace("{orders}", "orders").replace("{customer}", "customer")
    therm, point = named(THERMAL), named(POINTS)
    six = "(values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (-1, 1, 1), (-1, -1, 1)) d(dx, dy, slant)"
    return {
        "quantiles": "select event_type, count(value) as n, round(quantile_cont(value, 0.95), 9) as p95, min(value) as least, max(value) as most from events where value is not null group by 1",
        "ensemble_bins": "with s as (select l_orderkey, count(*) as size from lineitem group by 1), b as (select unnest(range(1, (select max(size) from s) + 1)) as size) select b.size, count(s.size) as n, round(b.size * count(s.size) / (select count(*) from lineitem), 9) as portion from b left join s using (size) group by 1",
        "order_parameter": "with c as (select f, t, q, (select count(*) from lineitem where l_returnflag = f and l_linestatus = t and l_linenumber = q) as n from (select distinct l_returnflag as f, l_linestatus as t from lineitem) p, (select unnest(range(1, 10)) as q) z) select f, t, round((max(n) - min(n)) / (select count(*) from lineitem where l_returnflag = f and l_linestatus = t), 9) as m, round(max(case when q = 1 then n end) / (select count(*) from lineitem where l_returnflag = f and l_linestatus = t), 9) as first from c group by f, t",
        "imbalance": "select l_suppkey as g, round(coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0) * 2 / sum(l_quantity) - 1, 9) as r from lineitem group by 1",
        "size_statistics": f"select l, count(*) as densities, min(n) as least, max(n) as most, cast(sum(n) as bigint) as n from ({point}) p group by l",
        "zero_ratios": "with z as (select l_suppkey, count(*) filter (l_discount < 0.005) / count(*) as a, count(*) filter (l_discount >= 0.005 and l_linestatus = 'O') / count(*) as b, count(*) filter (l_discount >= 0.005 and l_linestatus <> 'O') / count(*) as c, avg(l_quantity) as d, coalesce(stddev_samp(l_quantity), 0) as e from lineitem group by 1) select " + ", ".join(f"round(avg({c}), 9) as mean_{c}, round(coalesce(stddev_samp({c}), 0), 9) as sd_{c}" for c in "abcde") + " from z",
        "bootstrap_sem": f"""with r as (select f, t, rep, a1, last, {drawn} as w from (select *, {hashed} / 4294967296.0 as u from ({therm}) th, (select unnest(range(20)) as rep) z) y),
            s as (select f, t, rep, sum(w) as drawn, sum(w * a1) / nullif(sum(w), 0) as mean, max(last) as v from r group by 1, 2, 3),
            q as (select s.f, s.t, s.rep, any_value(drawn) as drawn, any_value(mean) as mean, any_value(v) as v, sum(w * (a1 - mean) * (a1 - mean)) / nullif(any_value(drawn), 0) as spread from r join s on r.f = s.f and r.t = s.t and r.rep = s.rep group by 1, 2, 3)
            select f, t, rep, drawn, round(mean, 9) as mean, round(sqrt(spread / nullif(drawn, 0)), 9) as sem, round(v * spread, 8) as chi_dis from q""",
        "key_sets": "with a as (select distinct o_custkey as k from orders), b as (select distinct user_id as k from events where user_id is not null) select (select count(*) from (select k from a union select k from b)) as n_union, (select count(*) from (select k from a intersect select k from b)) as n_both, (select count(*) from (select k from a except select k from b)) as n_first, (select count(*) from (select k from b except select k from a)) as missing",
        "best_trial": "select g, rmse, o, i from (select l_suppkey as g, l_extendedprice as rmse, l_orderkey as o, l_linenumber as i, row_number() over (partition by l_suppkey order by l_quantity <= 45, l_extendedprice, l_orderkey, l_linenumber) as r from lineitem) q where r = 1",
        "signatures": f"""select l, rho_key, sha256('{{"L":' || l || ',"rho":"' || printf('%.5f', rho_key / 100) || '"}}') as signature from ({point}) p""",
        "valid_times": "select c_nationkey, sum((v > 0)::int) as good, sum((v <= 0)::int) as bad, round(avg(s), 9) as mean_sweeps, round(stddev_pop(s), 9) as sd_sweeps, sum((v > 100)::int) as warned from (select c_nationkey, c_acctbal / 10 as v, case when c_acctbal > 0 then least(10000, greatest(20, ceil(50 * (c_acctbal / 10)))) else 10000 end as s from customer) q group by 1",
        "hexagonal_neighbours": sites + f""", hex as (select distinct s.sample_id, s.site, ((y + dy + l) % l) * l + (x + dx + slant * 2 * (y % 2) + l) % l as nb from site s, {six})
            select sample_id, occ, k, count(*) as n from (select s.sample_id, s.site, s.occ, coalesce(sum(b.occ), 0) as k from site s join hex using (sample_id, site) join site b on b.sample_id = s.sample_id and b.site = hex.nb group by 1, 2, 3) q group by 1, 2, 3""",
        "blocked_sites": sites + """ select sample_id, case when core = 1 then 1 when active = 0 then 2 else 0 end as state, count(*) as n, sum(case when occ = 1 and core = 0 then 1 else 0 end) as isolated from ruled group by 1, 2""",
        "k_core": sites.replace("with size", "with recursive size", 1) + """,
            pair as (select nb.sample_id, nb.site, nb.nb from nb join site a on a.sample_id = nb.sample_id and a.site = nb.site and a.occ = 1 join site b on b.sample_id = nb.sample_id and b.site = nb.nb and b.occ = 1),
            left_(sample_id, site, dead) using key (sample_id, site) as (select sample_id, site, 0 from site where occ = 1
             union (select r.sample_id, r.site, 1 from recurring.left_ r left join pair p on p.sample_id = r.sample_id and p.site = r.site left join recurring.left_ q on q.sample_id = p.sample_id and q.site = p.nb and q.dead = 0
              where r.dead = 0 group by r.sample_id, r.site having count(q.site) < 2))
            select sample_id, count(*) as n_occ, cast(sum(1 - dead) as bigint) as n_core, cast(sum(case when dead = 0 then site else 0 end) as bigint) as sites from left_ group by 1""",
        "open_borders": sites + """, o as (select sample_id, site, x, y, l, least(3, x, y, l - 1 - x, l - 1 - y) as ring, case when least(x, y, l - 1 - x, l - 1 - y) = 0 and (x + y) % 2 = 0 then 0 else occ end as occ from site)
            select a.sample_id, a.ring, count(distinct a.site) as n, (select sum(occ) from o c where c.sample_id = a.sample_id and c.ring = a.ring) as n_occ, sum(b.occ) as bonds
            from o a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy), o b where b.sample_id = a.sample_id and b.site = (a.y + dy) * a.l + a.x + dx and a.x + dx between 0 and a.l - 1 and a.y + dy between 0 and a.l - 1 group by 1, 2""",
    }
