"""Coarse models of blocks of sites, blocked sites of open lattices, and the undetermined graph as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.dynamics import unit


def block_model(table: DataFrame, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Spins and couplings of blocks of ``k`` by ``k`` sites of ``table(sample_id, site, x, y, occ, free)``, free 0 or 1, on periodic lattices of a ``length`` that ``k`` divides.

    ``(sample_id, bx, by, spin, tie, field)``: the sign of the checkerboard-signed occupation of the block's free sites, a coin by a hash where it is 0 (tie); field is the
    signed number of its free sites. ``(sample_id, bx, by, side, coupling)``: for side 0 (up, y - 1), 1 (right), 2 (down), 3 (left) the number of bonds to the next block whose two sites are free and empty: so each is listed from both ends.
    """
    if length % k:
        raise ValueError("blocks don't fill the lattice")
    parts = length // k
    sign = F.expr("1 - 2 * ((x + y) % 2)")
    own = table.select("sample_id", "site", "x", "y", "occ", "free", F.expr(f"x div {k}").alias("bx"), F.expr(f"y div {k}").alias("by"))
    sums = own.groupBy("sample_id", "bx", "by").agg(F.sum(sign * F.col("occ") * F.col("free")).alias("m"), F.sum(sign * F.col("free")).alias("field"))
    coin = F.when(unit(F.col("sample_id"), F.concat(F.lit("b"), (F.col("by") * parts + F.col("bx")).cast("string"))) < 0.5, 1).otherwise(-1)
    spins = sums.select("sample_id", "bx", "by", F.when(F.col("m") == 0, coin).otherwise(F.signum("m").cast("int")).alias("spin"), (F.col("m") == 0).alias("tie"), "field")
    empty = own.where("free = 1 and occ = 0")
    steps = [(0, -1), (1, 0), (0, 1), (-1, 0)]
    at = F.array(*[F.struct(F.lit(i).alias("side"), F.expr(f"pmod(y + {dy}, {length}) * {length} + pmod(x + {dx}, {length})").alias("nb"), F.expr(edge).alias("edge")) for i, ((dx, dy), edge) in enumerate(zip(steps, (f"y % {k} = 0", f"x % {k} = {k - 1}", f"y % {k} = {k - 1}", f"x % {k} = 0")))])
    sent = empty.select("sample_id", "bx", "by", F.explode(F.filter(at, lambda s: s["edge"])).alias("s")).select("sample_id", "bx", "by", "s.side", "s.nb")
    met = sent.join(empty.select("sample_id", F.col("site").alias("nb")), ["sample_id", "nb"], "left_semi").groupBy("sample_id", "bx", "by", "side").agg(F.count(F.lit(1)).alias("coupling"))
    every = spins.select("sample_id", "bx", "by", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("side"))
    return spins, every.join(met, ["sample_id", "bx", "by", "side"], "left").withColumn("coupling", F.coalesce("coupling", F.lit(0).cast("long")))


def blocked_open(table: DataFrame, length: int) -> DataFrame:
    """``table(sample_id, site, x, y, occ)`` of lattices with open sides, with ``state``: 1 blocked, 2 beside a blocked site, 0 else.

    An occupied site with an occupied neighbour is blocked. A corner counts as blocked as soon as it or one of its two neighbours is occupied.
    """
    near = F.filter(F.array(*[F.when(F.expr(inside), F.expr(to)) for inside, to in ((f"x < {length - 1}", "site + 1"), ("x > 0", "site - 1"), (f"y < {length - 1}", f"site + {length}"), ("y > 0", f"site - {length}"))]), lambda v: v.isNotNull())

    def beside(rows: DataFrame, flag: str, name: str) -> DataFrame:
        sent = rows.where(F.col(flag)).select("sample_id", F.explode(near).alias("site")).groupBy("sample_id", "site").agg(F.count(F.lit(1)).alias(name))
        return rows.join(sent, ["sample_id", "site"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    corner = F.expr(f"x in (0, {length - 1}) and y in (0, {length - 1})")
    one = beside(table.withColumn("_set", F.col("occ") == 1), "_set", "_near")
    one = one.withColumn("_blocked", F.when(corner, F.col("_set") | (F.col("_near") > 0)).otherwise(F.col("_set") & (F.col("_near") > 0)))
    two = beside(one, "_blocked", "_rim")
    return two.select(*table.columns, F.when(F.col("_blocked"), 1).when(F.col("_rim") > 0, 2).otherwise(0).alias("state"))


def undetermined_graph(solved: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``(sample_id, site, line)`` of the undetermined sites of a ground state: ``(x,y): (x',y') 1; (x'',y'') 0;`` with the undetermined neighbours in order of their site, 1 for the matched one.

    ``solved`` and ``edges(u, v)`` are those of ``pairing.ground`` on lattices of ``length``, nodes numbered ``sample_id * length^2 + site``.
    """
    size = length * length
    free = solved.where("state is null").select("node", "partner")
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    inside = both.join(free.select("node"), "node", "left_semi").join(free.select(F.col("node").alias("other")), "other", "left_semi")
    near = inside.groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("near"))  # at most four
    named = lambda v: F.format_string("(%d,%d)", v % size % length, F.floor(v % size / length))
    entry = lambda v: F.concat(F.lit(" "), named(v), F.when(v == F.col("partner"), " 1").otherwise(" 0"))
    line = F.concat(named(F.col("node")), F.lit(":"), F.array_join(F.transform(F.coalesce("near", F.array().cast("array<long>")), entry), ";"), F.lit(";"))
    return free.join(near, "node", "left").select(F.expr(f"cast(node div {size} as int)").alias("sample_id"), (F.col("node") % size).alias("site"), line.alias("line"))
