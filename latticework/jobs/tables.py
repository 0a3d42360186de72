"""Queries that write the driver's rows in the published layouts, read them again and sum them up."""

from __future__ import annotations

import uuid
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import shared_dir
from latticework.functions.ranks import numbered
from latticework.jobs.statistics import grid, points
from latticework.sources import tables


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def columns_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows in white-space columns under a comment line."""
    at = _place(spark)
    tables.write_columns(points(grid(spark, sf_dir)).select("l", "rho_key", "n", "p1"), at, ["l", "rho_key", "n", "p1"])
    own = tables.read_columns(spark, at, {"l": "int", "rho_key": "long", "n": "long", "p1": "double"})
    return own.select("l", "rho_key", "n", F.round("p1", 6).alias("p1"))


def csv_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma rows with blanks and a header; rows whose price is no number go."""
    at = _place(spark)
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    _orders(spark, sf_dir).select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias(" L"), price.alias(" rho")).write.csv(at, header=True, ignoreLeadingWhiteSpace=False)
    return tables.read_csv(spark, at, {"o_orderkey": "long", "price": "double"})


def samples_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows of an order's quantities; the filter on the size goes before the values."""
    at = _place(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tables.write_samples(lines, at, ["l_orderkey"], "l_linenumber", "l_quantity")
    own = tables.read_samples(spark, at, {"l_orderkey": "long"}, F.col("l_orderkey") % 2 == 0)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return own.select("l_orderkey", F.size("samples").cast("long").alias("n"), F.round(total / F.size("samples"), 9).alias("mean"), F.get("samples", 0).alias("first"))


def parameters_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key=value file with a parameter a part: numbers of both kinds, words and truth values."""
    at = _place(spark)
    value = F.expr("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then cast(p_retailprice as string) when 2 then p_brand else 'true' end")
    tables.write_parameters(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", value.alias("v")), at, "p_partkey", "v")
    return tables.read_parameters(spark, at).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))


def times_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of times with bad entries, read back: valid ones only, by the key."""
    at = _place(spark)
    tau = F.expr("case when o_orderkey % 7 = 0 then -o_totalprice when o_orderkey % 11 = 0 then null else o_totalprice end")
    own = _orders(spark, sf_dir).select(F.lit(2).alias("d"), F.expr("o_orderkey").alias("l"), F.expr("o_orderkey % 5").alias("w"), (F.col("o_custkey") / 1000).alias("rho"), tau.alias("tau"))
    for later in (0, 1):  # a second append with new times for some keys
        tables.write_columns(own.where(F.col("l") % 3 == 0).withColumn("tau", F.col("tau") + 1) if later else own, at, ["d", "l", "w", "rho", "tau"])
    return tables.read_times(spark, at)


def blocks_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block a customer nation: counts of orders by priority and their portions."""
    at = _place(spark)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    counts = _orders(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("double").alias("z"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a"))
    block = counts.groupBy("z").agg(F.max("a").alias("average"), F.sort_array(F.collect_list(F.struct("o_orderpriority", "n"))).alias("own"), F.sum("n").alias("all"))
    tables.write_blocks(block.select("z", "average", F.transform("own", lambda x: x["n"]).alias("by_size"), F.transform("own", lambda x: x["n"] / F.col("all")).alias("portion")), at)
    long = tables.read_blocks(spark, at).select("z", "average", F.posexplode(F.arrays_zip("by_size", "portion")).alias("size", "c"))
    return long.select("z", "average", (F.col("size") + 1).cast("long").alias("size"), "c.by_size", "c.portion")


def configurations_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a customer nation and order status, with a matrix of an order's priority and line numbers for each of its orders; read back: mean number of configurations by nation."""
    at = _place(spark)
    orders = _orders(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    row = F.array(F.col("o_orderkey") % 4, F.col("c_nationkey").cast("long") % 3)
    own = orders.select(F.col("c_nationkey").cast("double").alias("z"), F.lit(0.5).alias("t"), F.ascii("o_orderstatus").alias("graph"), F.col("o_orderkey").alias("n"), F.array(row, F.reverse(row)).alias("configuration"))
    tables.write_configurations(own, at)
    back = tables.read_configurations(spark, at)
    top = F.aggregate("configuration", F.lit(0).cast("long"), lambda a, r: a + r[0])
    graphs = back.groupBy("z", "t", "graph").agg(F.max("told").alias("told"), F.count("n").alias("n"), F.sum(top).alias("first"))
    return graphs.groupBy("z", "t").agg(F.count(F.lit(1)).alias("graphs"), F.sum("n").alias("n"), F.round(F.avg("told"), 9).alias("mean"), F.sum("first").alias("first"))


def coupling_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of a lattice of blocks whose field and couplings are a file of five numbers a line, one line an order, for spins by the orders' status."""
    at = _place(spark)
    orders = _orders(spark, sf_dir)
    length = max(1, isqrt(orders.count()))
    own = numbered(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), [], ["o_orderkey"], "site").where(F.col("site") < length * length)
    five = F.concat_ws(" ", *[((F.col("o_custkey") * k) % 17 / 8 - 1).cast("string") for k in (1, 3, 5, 7, 11)])
    own.select("site", five.alias("value")).orderBy("site").select("value").write.text(at)
    spins = own.select("site", F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1).alias("s"))
    return tables.coupled_energy(tables.read_couplings(spark, at, length), spins).select(F.lit(length).cast("long").alias("length"), F.round("energy", 6).alias("energy"))


def path_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters from paths, one path an order, with several spellings of rho."""
    rho = F.expr("case when o_orderkey % 2 = 0 then format_number(o_custkey / 1000, '0.000') else cast(o_custkey / 1000 as string) end")
    path = F.concat(F.lit("/runs/d=2-L="), F.col("o_orderkey").cast("string"), F.lit("-W=7-Periodic-main_seed=0/rho="), rho, F.lit("/main_seed.txt"))
    own = tables.with_path_parameters(_orders(spark, sf_dir).select(path.alias("path")), ["d", "L", "main_seed", "rho"])
    return own.groupBy("d", "main_seed", "rho").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("L").cast("long")).alias("sizes"))


QUERIES = {q.__name__: q for q in (columns_layout, csv_layout, samples_layout, parameters_layout, times_cache, blocks_layout, path_parameters, configurations_layout, coupling_energy)}

_NATIONS = "from orders join customer on o_custkey = c_custkey"
ORACLES = {
    "columns_layout": f"select c_nationkey as l, cast(floor(o_totalprice / 10000) as bigint) as rho_key, count(*) as n, round(avg(o_totalprice), 6) as p1 {_NATIONS} group by 1, 2",
    "csv_layout": "select o_orderkey, o_totalprice as price from orders where o_orderkey % 10 <> 0",
    "samples_layout": "select l_orderkey, count(*) as n, round(avg(l_quantity), 9) as mean, arg_min(l_quantity, struct_pack(a := l_linenumber, b := l_quantity)) as first from lineitem where l_orderkey % 2 = 0 group by 1",
    "parameters_layout": "select case p_partkey % 4 when 0 then 'int' when 1 then 'float' when 2 then 'str' else 'bool' end as kind, count(*) as n, sum(p_partkey) as keys from part group by 1",
    "times_cache": "select 2 as d, cast(o_orderkey as int) as l, cast(o_orderkey % 5 as int) as w, printf('%.6f', o_custkey / 1000) as rho_key, o_totalprice + (o_orderkey % 3 = 0)::int as tau from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_totalprice > 0",
    "blocks_layout": f"""select z, cast(printf('%.5f', max(a) over (partition by z)) as double) as average, row_number() over (partition by z order by o_orderpriority) as size, cast(n as double) as by_size, cast(printf('%.5f', n / sum(n) over (partition by z)) as double) as portion
        from (select cast(c_nationkey as double) as z, o_orderpriority, count(*) as n, avg(o_totalprice) as a {_NATIONS} group by 1, 2) q""",
    "configurations_layout": f"""with g as (select cast(c_nationkey as double) as z, o_orderstatus, count(*) as n, cast(sum(o_orderkey % 4 + c_nationkey % 3) as bigint) as first {_NATIONS} group by 1, 2)
        select z, cast(0.5 as double) as t, count(*) as graphs, sum(n) as n, round(avg(n), 9) as mean, sum(first) as first from g group by 1""",
    "coupling_energy": """with size as (select cast(floor(sqrt(count(*))) as bigint) as l from orders), o as (select row_number() over (order by o_orderkey) - 1 as site, o_custkey as k, case when o_orderstatus = 'O' then 1 else -1 end as s from orders),
        b as (select site, site // l as r, site % l as c, l, k, s from o, size where site < l * l), d as (select * from (values (3, -1, 0), (5, 0, 1), (7, 1, 0), (11, 0, -1)) v(m, dr, dc)),
        j as (select sum(0.5 * ((b.k * m) % 17 / 8 - 1) * b.s * e.s) as x from b, d, b e where e.site = (b.r + dr + b.l) % b.l * b.l + (b.c + dc + b.l) % b.l)
        select any_value(l) as length, round(-sum((k % 17 / 8 - 1) * s) - any_value(j.x), 6) as energy from b, j""",
    "path_parameters": "select '2' as d, '0' as main_seed, printf('%.6f', o_custkey / 1000) as rho, count(*) as n, sum(o_orderkey) as sizes from orders group by 3",
}
