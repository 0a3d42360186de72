"""Queries of block models, blocked sites of open lattices and the undetermined graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.jobs.decomposition import solved_lattices
from latticework.jobs.inputs import lattices
from latticework.operators import blocks, lattice

BLOCK = 2


def block_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample, of blocks of 2 by 2 of the active sites: ties, and sums of fields and couplings by side; also those with equal spins in both blocks."""
    table, n = lattices(spark, sf_dir)
    free = written(lattice.local_rules(table, n).select("sample_id", "site", "x", "y", "occ", F.col("active").alias("free")))
    spins, couplings = blocks.block_model(free, n, BLOCK)
    spins, parts = written(spins), n // BLOCK
    step = lambda c, back, on: F.pmod(F.col(c) + F.when(F.col("side") == back, -1).when(F.col("side") == on, 1).otherwise(0), F.lit(parts))
    other = spins.select("sample_id", F.col("bx").alias("nx"), F.col("by").alias("ny"), F.col("spin").alias("spin2"))
    both = couplings.withColumn("nx", step("bx", 3, 1)).withColumn("ny", step("by", 0, 2)).join(spins, ["sample_id", "bx", "by"]).join(other, ["sample_id", "nx", "ny"])
    return both.groupBy("sample_id", "side").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("coupling").alias("coupling"), F.sum(F.when(F.col("spin") == F.col("spin2"), F.col("coupling")).otherwise(0)).alias("aligned"),
        F.sum(F.col("field") * F.col("spin")).cast("long").alias("field"), F.count_if("tie").alias("ties"),
    )


def open_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of lattices with open sides by state and occupation."""
    table, n = lattices(spark, sf_dir)
    return blocks.blocked_open(table, n).groupBy("sample_id", "state", "occ").agg(F.count(F.lit(1)).alias("n"), F.sum("site").alias("sites"))


def undetermined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The undetermined sites of the ground states with their undetermined neighbours, as lines of text."""
    solved, edges, n = solved_lattices(spark, sf_dir)
    return blocks.undetermined_graph(solved, edges, n)


QUERIES = {q.__name__: q for q in (block_couplings, open_blocked, undetermined_lines)}


def oracles(sites: str, hashed: str) -> dict[str, str]:
    """SQL for an independent engine, given its lattice and its hash."""
    coin = hashed.format("sample_id", f"('b' || ((bx) + (by_) * (l // {BLOCK})))")
    return {
        "block_couplings": sites + f""", own as (select sample_id, site, x, y, l, occ, active as free, x // {BLOCK} as bx, y // {BLOCK} as by_, 1 - 2 * ((x + y) % 2) as sg from ruled),
         s as (select sample_id, bx, by_, any_value(l) as l, sum(sg * occ * free) as m, sum(sg * free) as field from own group by 1, 2, 3),
         t as materialized (select *, case when m > 0 then 1 when m < 0 then -1 when {coin} < 2147483648 then 1 else -1 end as spin from s),
         d as (select * from (values (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) v(side, dx, dy)),
         c as (select a.sample_id, a.bx, a.by_, side, count(*) as k from own a, d, own b where b.sample_id = a.sample_id and b.site = (a.y + dy + a.l) % a.l * a.l + (a.x + dx + a.l) % a.l and (b.bx <> a.bx or b.by_ <> a.by_)
          and a.free = 1 and b.free = 1 and a.occ = 0 and b.occ = 0 group by 1, 2, 3, 4),
         p as (select t.*, side, (t.bx + dx + t.l // {BLOCK}) % (t.l // {BLOCK}) as nx, (t.by_ + dy + t.l // {BLOCK}) % (t.l // {BLOCK}) as ny from t, d)
         select p.sample_id, p.side, count(*) as blocks, sum(coalesce(c.k, 0))::bigint as coupling, sum(case when p.spin = u.spin then coalesce(c.k, 0) else 0 end)::bigint as aligned, sum(p.field * p.spin)::bigint as field, count(*) filter (p.m = 0) as ties
         from p join t u on u.sample_id = p.sample_id and u.bx = p.nx and u.by_ = p.ny left join c on c.sample_id = p.sample_id and c.bx = p.bx and c.by_ = p.by_ and c.side = p.side group by 1, 2""",
        "open_blocked": sites + """, o as (select a.sample_id, a.site, any_value(a.occ) as occ, any_value(a.x) as x, any_value(a.y) as y, any_value(a.l) as l, coalesce(sum(b.occ), 0) as k from site a left join site b on b.sample_id = a.sample_id and abs(a.x - b.x) + abs(a.y - b.y) = 1
           and b.site in (a.site - 1, a.site + 1, a.site - a.l, a.site + a.l) group by 1, 2),
         b as materialized (select *, case when x in (0, l - 1) and y in (0, l - 1) then occ = 1 or k > 0 else occ = 1 and k > 0 end as blocked from o),
         e as materialized (select distinct b.sample_id, b.site + d as site from b, (select unnest([1, -1, 0, 0]) as dx, unnest([0, 0, 1, -1]) as dy) v, lateral (select v.dx + v.dy * b.l as d) z where blocked and b.x + dx between 0 and l - 1 and b.y + dy between 0 and l - 1)
         select b.sample_id, case when blocked then 1 when e.site is not null then 2 else 0 end as state, occ, count(*) as n, sum(b.site)::bigint as sites from b left join e on e.sample_id = b.sample_id and e.site = b.site group by 1, 2, 3""",
    }
