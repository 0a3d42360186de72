"""Queries of finite-size scaling: curves of lattices that are cut from the orders' ones, and their collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.jobs.inputs import SAMPLES
from latticework.operators import collapse, lattice

#: Densities of the curves, around the threshold of sites on a square lattice.
DENSITIES = [round(0.56 + 0.01 * k, 2) for k in range(8)]


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l, rho, p, sigma, n)``: mean largest cluster of occupied sites, as a share of the lattice, and its standard error, of lattices of three sizes cut from one over the order keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bounds = orders.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low")).first()
    width = int(bounds["n"] ** 0.5) // 8 * 8
    keys = orders.select((F.col("o_orderkey") - (bounds["low"] or 0)).alias("site")).where(F.col("site") < width * width)
    draws = keys.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("u", lattice.uniform(F.col("s"), F.col("site")))
    sets = written(draws.select("s", "u", (F.col("site") % max(1, width)).alias("x"), F.floor(F.col("site") / max(1, width)).alias("y")).where(F.col("u") < int(DENSITIES[-1] * 2**32)))
    found = None
    for parts in (8, 4, 2):
        size = width // parts
        if size < 2:
            continue
        lattice_id = ((F.col("s") * parts + F.floor(F.col("x") / size)) * parts + F.floor(F.col("y") / size)) * len(DENSITIES) + F.col("k")
        own = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(DENSITIES) - 1)))).where(F.col("u") < F.element_at(F.array(*[F.lit(int(d * 2**32)) for d in DENSITIES]), F.col("k").cast("int") + 1))
        table = own.select(lattice_id.cast("long").alias("sample_id"), ((F.col("y") % size) * size + F.col("x") % size).alias("site"), (F.col("x") % size).alias("x"), (F.col("y") % size).alias("y"), F.lit(1).alias("on"))
        largest = lattice.clusters(table, "on", size).groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("sample_id").agg((F.max("n") / F.lit(size * size)).alias("m"))
        rho = F.element_at(F.array(*[F.lit(d) for d in DENSITIES]), (F.col("sample_id") % len(DENSITIES)).cast("int") + 1)
        rows = largest.groupBy(F.lit(size).alias("l"), rho.alias("rho")).agg(F.avg("m").alias("p"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("sigma"), F.count(F.lit(1)).alias("n"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "l int, rho double, p double, sigma double, n long")
    return written(found)


def scaling_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves themselves, rounded."""
    return _curves(spark, sf_dir).select("l", "rho", F.round("p", 9).alias("p"), F.round("sigma", 9).alias("sigma"), "n")


def collapse_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical density and exponents of the curves' collapse: best of the starts, with deviations and intervals over 20 draws."""
    fits = written(collapse.collapse(_curves(spark, sf_dir).withColumn("curve", F.lit("largest cluster")), ["curve"], starts=4, draws=20, degree=8, floor=1e-6))
    return collapse.over_draws(collapse.best_starts(fits, ["curve"]), ["curve"])


QUERIES = {q.__name__: q for q in (scaling_curves, collapse_fit)}


def oracles(hashed: str) -> dict[str, str]:
    """SQL for an independent engine, given its hash."""
    rhos = ", ".join(map(str, DENSITIES))
    return {
        "scaling_curves": f"""with recursive w as (select cast(floor(floor(sqrt(count(*))) / 8) * 8 as bigint) as w, min(o_orderkey) as low from orders),
         u as materialized (select s.s, (o_orderkey - low) % w as x, (o_orderkey - low) // w as y, w, {hashed.format('s.s', '(o_orderkey - low)')} as u from orders, w, (select unnest(range({SAMPLES})) as s) s where o_orderkey - low < w * w),
         site as materialized (select s, r.rho, p.parts, w // p.parts as l, x // (w // p.parts) as ox, y // (w // p.parts) as oy, x % (w // p.parts) as x, y % (w // p.parts) as y from u, (select unnest([{rhos}]::double[]) as rho) r, (values (8), (4), (2)) p(parts)
          where u < floor(r.rho * 4294967296) and w // p.parts >= 2),
         node as materialized (select row_number() over (order by parts, rho, s, ox, oy, y, x) as id, * from site),
         pair as materialized (select a.id as a, b.id as b from node a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy), node b
          where b.parts = a.parts and b.rho = a.rho and b.s = a.s and b.ox = a.ox and b.oy = a.oy and b.x = (a.x + dx + a.l) % a.l and b.y = (a.y + dy + a.l) % a.l and b.id <> a.id),
         cc(id, label) using key (id) as (select id, id from node union (select p.a, min(c.label) from pair p join cc c on c.id = p.b join recurring.cc r on r.id = p.a where c.label < r.label group by p.a)),
         big as (select l, rho, s, ox, oy, max(n) / (l * l) as m from (select l, rho, s, ox, oy, label, count(*) as n from node join cc using (id) group by l, rho, s, ox, oy, label) q group by l, rho, s, ox, oy)
         select cast(l as int) as l, rho, round(avg(m), 9) as p, round(stddev_samp(m) / sqrt(count(*)), 9) as sigma, count(*) as n from big group by 1, 2""",
    }
