"""Registered queries by name, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jobs import blocks, decomposition, dynamics, grids, reports, scaling, series, statistics, tables
from latticework.jobs.inputs import DENSITY, POISSON, SAMPLES, active_clusters, lattices
from latticework.jobs.statistics_sql import QUERIES as STATISTICS
from latticework.operators import lattice, matching


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, length = lattices(spark, sf_dir)
    ruled = lattice.local_rules(table, length)
    return ruled.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("n_occ"), F.sum("core").alias("n_core"), F.sum("active").alias("n_active"))


def checkerboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, length = lattices(spark, sf_dir)
    side = F.expr("(x + y) % 2")
    return lattice.local_rules(table, length).groupBy("sample_id", side.alias("side")).agg(F.sum("active").alias("n_active"), F.sum("occ").alias("n_occ"))


def bond_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds once, right and down: both ends active, equal and unequal occupation."""
    table, length = lattices(spark, sf_dir)
    ruled = lattice.local_rules(table, length).select("sample_id", "site", "x", "y", "active", "occ")
    ends = ruled.select("sample_id", F.col("site").alias("nb"), F.col("active").alias("active2"), F.col("occ").alias("occ2"))
    pairs = ruled.withColumn("nb", F.explode(F.array(*[F.element_at(lattice.neighbour_numbers(length), i) for i in (1, 3)]))).join(ends, ["sample_id", "nb"])
    spin = (2 * F.col("occ") - 1) * (2 * F.col("occ2") - 1)
    return pairs.where("active = 1 and active2 = 1").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_bonds"), F.sum(spin).alias("energy"), F.sum((1 - F.col("occ")) * (1 - F.col("occ2"))).alias("defects"))


def coarse_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of the checkerboard-signed occupation in blocks of 4 by 4."""
    table, length = lattices(spark, sf_dir)
    signed = F.expr("(2 * occ - 1) * (1 - 2 * ((x + y) % 2))")
    own = table.groupBy("sample_id", F.expr("x div 4").alias("bx"), F.expr("y div 4").alias("by")).agg(F.sum(signed).alias("field"))
    return own.select("sample_id", "bx", "by", "field", F.signum("field").cast("int").alias("spin"))


def sublattice3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = lattices(spark, sf_dir)
    return table.groupBy("sample_id", F.expr("(x + 2 * (y % 2)) % 3").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("n_occ"))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    found, length = active_clusters(spark, sf_dir)
    return found.groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("size")), length


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir)[0].groupBy("sample_id", "size").agg(F.count(F.lit(1)).alias("n_clusters"))


def largest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and Binder cumulant of the largest active cluster's density over the samples."""
    sizes, length = _sizes(spark, sf_dir)
    density = sizes.groupBy("sample_id").agg((F.max("size") / F.lit(length * length)).alias("d"))
    moments = density.agg(F.count(F.lit(1)).alias("samples"), F.avg("d").alias("m1"), F.avg(F.col("d") ** 2).alias("m2"), F.avg(F.col("d") ** 4).alias("m4"))
    binder = F.when(F.col("m2") > 1e-15, 1 - F.col("m4") / (3 * F.col("m2") ** 2)).otherwise(0.0)
    return moments.select("samples", F.round("m1", 9).alias("m1"), F.round("m2", 9).alias("m2"), F.round("m4", 9).alias("m4"), F.round(binder, 9).alias("binder"))


def mis_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground states of the active sites in open tiles of 16 by 16."""
    table, length = lattices(spark, sf_dir)
    own = lattice.local_rules(table, length).where("active = 1")
    return matching.ground_states(own.select("sample_id", F.expr("x div 16").alias("tx"), F.expr("y div 16").alias("ty"), "x", "y"), ["sample_id", "tx", "ty"])


def bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 20 resamplings of the orders' line counts, by status: each order is drawn Poisson(1) times, by a hash.

    Weights instead of drawn indices need no join and are summed on the map side.
    """
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    rep = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    u = lattice.uniform(F.col("rep"), F.col("l_orderkey")) / F.lit(float(2**32))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    sums = rep.withColumn("w", weight).groupBy("rep", "o_orderstatus").agg(F.sum("w").alias("drawn"), F.sum(F.col("w") * F.col("n")).alias("total"))
    return sums.select("rep", "o_orderstatus", "drawn", F.round(F.try_divide("total", "drawn"), 9).alias("mean"))


QUERIES = {
    "lattice_rules": lattice_rules, "checkerboard_counts": checkerboard_counts, "bond_energy": bond_energy, "coarse_field": coarse_field,
    "sublattice3_counts": sublattice3_counts, "cluster_sizes": cluster_sizes, "largest_cluster": largest_cluster, "mis_observables": mis_observables,
    "bootstrap_hash": bootstrap_hash,
} | series.QUERIES | statistics.QUERIES | tables.QUERIES | reports.QUERIES | dynamics.QUERIES | decomposition.QUERIES | scaling.QUERIES | grids.QUERIES | blocks.QUERIES

_HASH = "('0x' || substr(md5(cast({0} as varchar) || '-' || cast({1} as varchar)), 1, 8))::bigint"
_SITES = f"""with size as (select cast(floor(floor(sqrt(count(*))) / 2) * 2 as bigint) as l, min(o_orderkey) as low from orders),
 site as (select s.sample_id, o_orderkey - low as site, (o_orderkey - low) % l as x, (o_orderkey - low) // l as y, l,
  case when {_HASH.format('s.sample_id', '(o_orderkey - low)')} < {int(DENSITY * 2**32)} then 1 else 0 end as occ
  from orders, size, (select unnest(range({SAMPLES})) as sample_id) s where o_orderkey - low < l * l),
 nb as (select distinct sample_id, site, ((y + dy + l) % l) * l + (x + dx + l) % l as nb from site, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)),
 core as (select distinct a.sample_id, a.site from site a join nb using (sample_id, site) join site b on b.sample_id = a.sample_id and b.site = nb.nb where a.occ = 1 and b.occ = 1),
 touched as (select distinct nb.sample_id, nb.site from nb join core on core.sample_id = nb.sample_id and core.site = nb.nb),
 ruled as (select s.*, case when c.site is null then 0 else 1 end as core, case when t.site is null then 1 else 0 end as active
  from site s left join core c using (sample_id, site) left join touched t using (sample_id, site))"""
_CLUSTERS = _SITES.replace("with size", "with recursive size", 1) + """,
 pair as (select nb.sample_id, nb.site, nb.nb from nb join ruled a on a.sample_id = nb.sample_id and a.site = nb.site and a.active = 1 join ruled b on b.sample_id = nb.sample_id and b.site = nb.nb and b.active = 1),
 cc(sample_id, site, label) using key (sample_id, site) as (select sample_id, site, site from ruled where active = 1
  union (select p.sample_id, p.site, min(c.label) from pair p join cc c on c.sample_id = p.sample_id and c.site = p.nb join recurring.cc r on r.sample_id = p.sample_id and r.site = p.site
   where c.label < r.label group by p.sample_id, p.site)),
 sizes as (select sample_id, label, count(*) as size from cc group by sample_id, label)"""
_DRAWN = " + ".join(f"case when u >= {c!r} then 1 else 0 end" for c in POISSON)

ORACLES = {
    "lattice_rules": _SITES + " select sample_id, count(*) as n, sum(occ) as n_occ, sum(core) as n_core, sum(active) as n_active from ruled group by sample_id",
    "checkerboard_counts": _SITES + " select sample_id, (x + y) % 2 as side, sum(active) as n_active, sum(occ) as n_occ from ruled group by 1, 2",
    "bond_energy": _SITES + """ select a.sample_id, count(*) as n_bonds, sum((2 * a.occ - 1) * (2 * b.occ - 1)) as energy, sum((1 - a.occ) * (1 - b.occ)) as defects
        from ruled a, (values (1, 0), (0, 1)) d(dx, dy), ruled b where b.sample_id = a.sample_id and b.site = ((a.y + dy) % a.l) * a.l + (a.x + dx) % a.l and a.active = 1 and b.active = 1 group by 1""",
    "coarse_field": _SITES + " select sample_id, x // 4 as bx, y // 4 as by, sum((2 * occ - 1) * (1 - 2 * ((x + y) % 2))) as field, cast(sign(sum((2 * occ - 1) * (1 - 2 * ((x + y) % 2)))) as int) as spin from site group by 1, 2, 3",
    "sublattice3_counts": _SITES + " select sample_id, (x + 2 * (y % 2)) % 3 as class, count(*) as n, sum(occ) as n_occ from site group by 1, 2",
    "cluster_sizes": _CLUSTERS + " select sample_id, size, count(*) as n_clusters from sizes group by 1, 2",
    "largest_cluster": _CLUSTERS + """, d as (select max(size) / (select cast(l * l as double) from size) as d from sizes group by sample_id), m as (select count(*) as samples, avg(d) as m1, avg(d * d) as m2, avg(d * d * d * d) as m4 from d)
        select samples, round(m1, 9) as m1, round(m2, 9) as m2, round(m4, 9) as m4, round(case when m2 > 1e-15 then 1 - m4 / (3 * m2 * m2) else 0 end, 9) as binder from m""",
    "bootstrap_hash": f"""select rep, o_orderstatus, sum(w) as drawn, round(sum(w * n) / nullif(sum(w), 0), 9) as mean from (select rep, o_orderstatus, n, {_DRAWN} as w from (
        select r.rep, o_orderstatus, n, {_HASH.format('r.rep', 'l_orderkey')} / 4294967296.0 as u from (select l_orderkey, count(*) as n from lineitem group by 1) c join orders on o_orderkey = l_orderkey, (select unnest(range(20)) as rep) r) q) z group by 1, 2""",
} | series.ORACLES | tables.ORACLES | reports.oracles(_SITES, _HASH.format('rep', 's'), _DRAWN) | dynamics.oracles(_SITES, _HASH) | decomposition.oracles(_CLUSTERS, _HASH) | scaling.oracles(_HASH) | grids.oracles(_SITES, _HASH) | blocks.oracles(_SITES, _HASH) | {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in STATISTICS.items()}
