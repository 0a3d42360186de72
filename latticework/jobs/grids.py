"""Queries of parameter grids, lookups, remaining sites and drawn susceptibilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jobs.inputs import lattices
from latticework.operators import dynamics, grids, lattice, lookups

#: A site with so many occupied neighbours is blocked.
BLOCKED = 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def density_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of grids whose bounds follow each nation's customers: equally spaced, by steps, denser about a centre, and denser inside a part."""
    own = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    low, high, n = F.lit(0.2), 0.2 + F.col("n") / (F.col("n") + 7), (F.col("n") % 23 + 9).cast("int")
    middle = (low + high) / 2
    kinds = {
        "even": grids.linspace(low, high, n), "steps": grids.arithmetic(low, F.lit(0.05), high), "centre": grids.concentrated(low, high, low + (high - low) * 0.4, n, F.lit(2.0)),
        "dense": grids.dense(low, high, n, F.when(F.col("g") % 5 != 0, middle - 0.05), middle + 0.05, F.lit(3)),
    }
    found = own.select("g", F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values()))).alias("kind", "values"))
    return found.select("g", "kind", F.posexplode("values").alias("at", "rho")).select("g", "kind", F.col("at").cast("long").alias("at"), F.round("rho", 12).alias("rho"))


def remaining_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample: occupied and remaining sites, and the occupied among these."""
    table, length = lattices(spark, sf_dir)
    left = lattice.remaining(table, length, BLOCKED)
    return left.groupBy("sample_id").agg(F.sum("occ").alias("n_occ"), F.sum("remain").cast("long").alias("n_remain"), F.sum(F.col("occ") * F.col("remain")).cast("long").alias("both"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of each order's customer from a cache of customers with a positive balance, else by the order's own price."""
    cache = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("tau"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100).alias("own"))
    found = lookups.looked_up(orders, cache, ["o_custkey"], "tau", fallback="own")
    return found.select("o_orderkey", "o_custkey", F.round("tau", 6).alias("tau"))


def raw_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts, each a little off, back to the catalogue's prices of their size."""
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("l"), F.col("p_retailprice").alias("v"))
    raw = parts.withColumn("v", F.col("v") + (F.col("p_partkey") % 11 - 5) / 1000)
    found = lookups.nearest_target(raw, parts.select("l", "v"), ["l"], "v", 0.0035, strict=False)
    return found.select("p_partkey", "l", F.round("target", 6).alias("target"))


def drawn_susceptibility(spark: SparkSession, sf_dir: str, draws: int = 20) -> DataFrame:
    """Normal draws of each nation's mean balance with its standard error, never below 1e-12; mean and deviation of the draws."""
    own = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)))).alias("e"))
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    z = dynamics.gaussian(F.col("draw"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    value = F.greatest(F.lit(1e-12), F.col("m") + F.coalesce("e", F.lit(0.0)) * z)
    return drawn.withColumn("v", value).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("sd"))


QUERIES = {q.__name__: q for q in (density_grids, remaining_sites, cache_lookup, raw_to_target, drawn_susceptibility)}


def oracles(sites: str, hashed: str) -> dict[str, str]:
    """SQL for an independent engine, given its lattice and its hash."""
    h = lambda end: hashed.format("draw", f"('n' || c_nationkey || '{end}')")
    return {
        "density_grids": """with p as (select c_nationkey as g, 0.2::double as lo, 0.2::double + count(*) / (count(*) + 7) as hi, cast(count(*) % 23 + 9 as int) as n from customer group by 1), q as (select *, (lo + hi) / 2 as mid from p),
          o as (select *, n - 3 as outer_n, mid - 0.05::double - lo as l1, hi - (mid + 0.05::double) as l2 from q where g % 5 <> 0), f as (select *, case when outer_n - greatest(2, round(outer_n * l1 / (l1 + l2))) < 2 then outer_n - 2 else cast(greatest(2, round(outer_n * l1 / (l1 + l2))) as int) end as n1 from o),
          v as (select 'even' as kind, g, lo + i * (hi - lo) / (n - 1) as rho from q, range(0, 40) r(i) where i < n
           union all select 'steps', g, 0.2::double + i * 0.05::double from q, range(0, 40) r(i) where 0.2::double + i * 0.05::double <= hi + 1e-9::double
           union all select distinct 'centre', g, rho from (select g, lo, hi, lo + (hi - lo) * 0.4::double + sign(2.0::double * i / (n - 1) - 1) * pow(abs(2.0::double * i / (n - 1) - 1), 2) * greatest((hi - lo) * 0.4::double, abs(hi - lo - (hi - lo) * 0.4::double)) as x, round(x, 6) as rho from q, range(0, 40) r(i) where i < n) z where x between lo - 1e-9::double and hi + 1e-9::double
           union all select 'dense', g, lo + i * (hi - lo) / (n - 1) from q, range(0, 40) r(i) where i < n and g % 5 = 0
           union all select 'dense', g, lo + i * l1 / (n1 - 1) from f, range(0, 40) r(i) where i < n1 union all select 'dense', g, mid + 0.05::double + i * l2 / (outer_n - n1 - 1) from f, range(0, 40) r(i) where i < outer_n - n1
           union all select 'dense', g, mid - 0.05::double + i * 0.1::double / 4 from f, range(1, 4) r(i))
          select g, kind, row_number() over (partition by g, kind order by rho) - 1 as at, round(rho, 12) as rho from v""",
        "remaining_sites": sites.replace("with size", "with recursive size", 1) + f""",
          a as materialized (select s.sample_id, s.site, any_value(s.occ) as occ, (sum(b.occ) < {BLOCKED})::int as free from site s join nb using (sample_id, site) join site b on b.sample_id = s.sample_id and b.site = nb.nb group by 1, 2),
          b as materialized (select a.sample_id, a.site, any_value(a.occ) as occ from a join nb using (sample_id, site) join a c on c.sample_id = a.sample_id and c.site = nb.nb where a.free = 1 group by 1, 2 having sum(c.free) > 0),
          link as materialized (select nb.* from nb join b using (sample_id, site) join b c on c.sample_id = nb.sample_id and c.site = nb.nb),
          cc(sample_id, site, label) using key (sample_id, site) as (select sample_id, site, site from b union (select p.sample_id, p.site, min(c.label) from link p join cc c on c.sample_id = p.sample_id and c.site = p.nb
           join recurring.cc r on r.sample_id = p.sample_id and r.site = p.site where c.label < r.label group by p.sample_id, p.site)),
          best as (select sample_id, label from (select sample_id, label, row_number() over (partition by sample_id order by count(*) desc, label) as r from cc group by 1, 2) q where r = 1)
          select s.sample_id, sum(s.occ) as n_occ, count(best.label) as n_remain, sum(case when best.label is null then 0 else s.occ end)::bigint as both from site s left join cc using (sample_id, site) left join best on best.sample_id = s.sample_id and best.label = cc.label group by 1""",
        "cache_lookup": "select o_orderkey, o_custkey, round(coalesce(c_acctbal, o_totalprice / 100), 6) as tau from orders left join customer on c_custkey = o_custkey and c_acctbal > 0",
        "raw_to_target": """with r as (select p_partkey, p_size as l, p_retailprice + (p_partkey % 11 - 5) / 1000 as v from part), m as (select r.p_partkey, arg_min(t.v, struct_pack(gap := abs(r.v - t.v), v := t.v)) as target from r join (select distinct p_size as l, p_retailprice as v from part) t on t.l = r.l and abs(r.v - t.v) <= 0.0035::double group by 1)
          select p_partkey, l, round(target, 6) as target from r left join m using (p_partkey)""",
        "drawn_susceptibility": f"""with m as (select c_nationkey, avg(c_acctbal) as m, coalesce(stddev_samp(c_acctbal) / sqrt(count(*)), 0) as e from customer group by 1),
          d as (select c_nationkey, greatest(1e-12::double, m + e * (round(sqrt(-2 * ln(({h('a')} + 1) / 4294967296.0)) * cos(2 * pi() * {h('b')} / 4294967296.0) * 1048576) / 1048576)) as v from m, (select unnest(range(1, 21)) as draw) r)
          select c_nationkey, count(*) as draws, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd from d group by 1""",
    }
