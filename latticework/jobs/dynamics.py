"""Queries of sampled dynamics, ground states of whole lattices, lattices in three dimensions and laws of shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jobs.decomposition import solved_lattices
from latticework.jobs.inputs import lattices
from latticework.functions.durable import written
from latticework.operators import dynamics, fits, lattice

SWEEPS, RATE, SIGMA, BETA, STATES = 2, 0.3, 0.5, 0.8, 3


def _drawn(t: int, what: str) -> Column:
    """The uniform number of a site in half sweep ``t``."""
    return dynamics.unit(F.col("sample_id"), F.concat(F.lit(f"{what}{t}+"), F.col("site").cast("string")))


def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat bath under a constraint: a site without set neighbours is set anew with probability ``RATE``; set sites, changed sites and whether these are over three in ten, by sample."""
    table, n = lattices(spark, sf_dir)
    start = table.select("sample_id", "site", F.col("occ").alias("s"))
    now = dynamics.swept(start, n, SWEEPS, 2, F.lit(1.0), lambda t: F.when(F.col("w1") == 0, (_drawn(t, "k") < RATE).cast("int")).otherwise(F.col("s")))
    changed = (F.col("s") != F.col("before")).cast("int")
    own = now.join(start.withColumnRenamed("s", "before"), ["sample_id", "site"]).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("n_set"), F.sum(changed).alias("changed"))
    return own.select("sample_id", "n", "n_set", "changed", (F.col("changed") > F.ceil(0.3 * F.col("n"))).alias("new"))


def field_ising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spins of +1 (set) and -1 in a Gaussian field: a flip is taken with 1 / (1 + exp(beta * change of energy)); energy density and magnetisation by sample."""
    table, n = lattices(spark, sf_dir)
    field = SIGMA * dynamics.gaussian(F.col("sample_id"), F.concat(F.lit("h"), F.col("site").cast("string")))
    spin = 2 * F.col("s") - 1
    change = -2 * spin * (field + F.col("w1") - F.col("w0"))
    rule = lambda t: F.when(_drawn(t, "g") < 1 / (1 + F.exp(BETA * change)), 1 - F.col("s")).otherwise(F.col("s"))
    now = dynamics.swept(table.select("sample_id", "site", F.col("occ").alias("s")), n, SWEEPS, 2, F.lit(1.0), rule)
    unlike = _bonds(now, n).groupBy("sample_id").agg(F.sum((2 * F.col("s") - 1) * (2 * F.col("s2") - 1)).alias("bonds"))
    own = now.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(spin).alias("m"), F.sum(spin * field).alias("h"))
    return own.join(unlike, "sample_id").select("sample_id", "n", "m", F.round((F.col("bonds") + F.col("h")) / F.col("n"), 6).alias("energy"))


def _bonds(table: DataFrame, length: int) -> DataFrame:
    """Each bond once: ``(sample_id, site, nb, s, s2)``."""
    out = table.withColumn("nb", F.explode(lattice.grid_neighbours(length))).where("nb > site")
    return out.join(table.select("sample_id", F.col("site").alias("nb"), F.col("s").alias("s2")), ["sample_id", "nb"])


def disordered_potts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spins of ``STATES`` states with Gaussian couplings and fields, Metropolis: energy density, order parameter and fractions by sample."""
    table, n = lattices(spark, sf_dir)
    seed, site, s = F.col("sample_id"), F.col("site").cast("string"), F.col("s")
    start = table.select("sample_id", "site", F.floor(STATES * dynamics.unit(seed, F.concat(F.lit("s"), site))).alias("s"))
    coupling = dynamics.gaussian(seed, dynamics.bond_key(F.col("site"), F.col("nb")))
    fields = F.array(*[dynamics.gaussian(seed, F.concat(F.lit(f"f{q}+"), site)) for q in range(STATES)])
    weights = F.array(*[f"w{q}" for q in range(STATES)])

    def rule(t: int) -> Column:
        to = F.floor(STATES * _drawn(t, "q")).cast("int")
        gain = F.get(weights, to) - F.get(weights, s) + F.get(fields, to) - F.get(fields, s)
        return F.when((gain >= 0) | (_drawn(t, "m") < F.exp(BETA * gain)), to).otherwise(s)

    now = dynamics.swept(start, n, SWEEPS, STATES, coupling, rule)
    bonds = _bonds(now, n).groupBy("sample_id").agg(F.sum(F.when(F.col("s") == F.col("s2"), coupling).otherwise(0.0)).alias("j"))
    counts = [F.count_if(s == q).alias(f"n{q}") for q in range(STATES)]
    own = now.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get(fields, s)).alias("h"), *counts).join(bonds, "sample_id")
    all_ = [F.col(f"n{q}") for q in range(STATES)]
    return own.select("sample_id", "n", F.round(-(F.col("j") + F.col("h")) / F.col("n"), 6).alias("energy"), F.round((F.greatest(*all_) - F.least(*all_)) / F.col("n"), 9).alias("order"), *[f"n{q}" for q in range(STATES)])


def cubic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied, core and active sites of cubic lattices over the order keys, occupied by probability and by vacancy (``use_p``)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ends = orders.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low")).first()
    side = int(round(ends["n"] ** (1 / 3)))
    n = (side - (side**3 > ends["n"])) // 2 * 2
    own = orders.select((F.col("o_orderkey") - (ends["low"] or 0)).alias("site")).where(F.col("site") < n**3)
    own = own.withColumn("use_p", F.explode(F.array(F.lit(True), F.lit(False))))
    u, limit = dynamics.unit(F.lit(0), F.concat(F.lit("c"), F.col("site").cast("string"))), 0.125
    table = own.select("use_p", "site", F.when(F.col("use_p"), u < limit).otherwise(u > limit).cast("int").alias("occ"))

    def near(rows: DataFrame, flag: str, name: str) -> DataFrame:
        sent = rows.where(F.col(flag) == 1).select("use_p", F.explode(lattice.grid_neighbours(n, 3)).alias("site")).groupBy("use_p", "site").agg(F.count(F.lit(1)).alias(name))
        return rows.join(sent, ["use_p", "site"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    one = near(table, "occ", "k").withColumn("core", F.expr("case when occ = 1 and k > 0 then 1 else 0 end"))
    two = near(one, "core", "c")
    return two.groupBy("use_p").agg(F.count(F.lit(1)).alias("n"), F.sum("occ").alias("n_occ"), F.sum("k").alias("ends"), F.sum("core").alias("n_core"), F.count_if(F.col("c") == 0).alias("n_active"))


def _ground(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The active sites of whole lattices with their cluster, frozen state and membership."""
    solved, _, n = solved_lattices(spark, sf_dir)
    at = F.col("node") % (n * n)
    return solved.select(F.expr(f"cast(node div {n * n} as int)").alias("sample_id"), "cluster", (at % n).alias("x"), F.floor(at / n).alias("y"), "side", "state", "mis"), n


def ground_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample, of all active sites and of the largest cluster: E, R, frozen and free sites of both sides."""
    sites, _ = _ground(spark, sf_dir)
    names = [(f"{kind}_{'ab'[p]}", F.count_if((F.col("side") == p) & test)) for kind, test in (("in", F.col("state") == 1), ("out", F.col("state") == 0), ("free", F.col("state").isNull()), ("mis", F.col("mis") == 1), ("n", F.lit(True))) for p in (0, 1)]
    by_cluster = written(sites.groupBy("sample_id", "cluster").agg(*[c.alias(k) for k, c in names]))
    best = by_cluster.groupBy("sample_id").agg(F.max_by("cluster", F.struct(F.col("n_a") + F.col("n_b"), -F.col("cluster"))).alias("cluster"))
    both = by_cluster.withColumn("largest", F.lit(False)).unionByName(by_cluster.join(best, ["sample_id", "cluster"]).withColumn("largest", F.lit(True)))
    sums = both.groupBy("sample_id", "largest").agg(*[F.sum(k).alias(k) for k, _ in names])
    share = lambda p: F.coalesce(F.try_divide(f"mis_{p}", f"n_{p}"), F.lit(0.0))
    e = F.col("mis_a") + F.col("mis_b")
    return sums.select("sample_id", "largest", *[k for k, _ in names], F.round(e / (F.col("n_a") + F.col("n_b")), 9).alias("e"), F.round(share("a") - share("b"), 9).alias("r"))


def ground_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond energy and defects of the ground state's membership over active bonds, a number of active sites."""
    sites, n = _ground(spark, sf_dir)
    table = sites.select("sample_id", (F.col("y") * n + F.col("x")).alias("site"), F.col("mis").alias("s"))
    pair = _bonds(table, n).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_bonds"), F.sum((2 * F.col("s") - 1) * (2 * F.col("s2") - 1)).alias("spins"), F.sum((1 - F.col("s")) * (1 - F.col("s2"))).alias("defects"))
    own = table.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_active")).join(pair, "sample_id", "left")
    part = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n_active"), 9).alias(c)
    return own.select("sample_id", "n_active", F.coalesce("n_bonds", F.lit(0).cast("long")).alias("n_bonds"), part("spins"), part("defects"))


def dirichlet_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest Dirichlet law of the shares of a customer's lines by flag, in each market segment."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == f).alias(f.lower()) for f in "ANR"])
    own = lines.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.sum(c).alias(c) for c in "anr"])
    shares = own.join(read("customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_mktsegment", *[F.try_divide(F.col(c), F.col("a") + F.col("n") + F.col("r")).alias(c) for c in "anr"])
    return fits.dirichlet(shares, ["c_mktsegment"], list("anr")).select("c_mktsegment", F.col("n").alias("customers"), *[F.round(f"alpha_{c}", 6).alias(f"alpha_{c}") for c in "anr"])


QUERIES = {q.__name__: q for q in (constrained, field_ising, disordered_potts, cubic_rules, ground_observables, ground_bonds, dirichlet_by_segment)}


def oracles(sites: str, hashed: str) -> dict[str, str]:
    """SQL for an independent engine, given its lattice and its hash: neighbours by coordinates, one table a half sweep."""
    unit = lambda key: f"({hashed.format('a.sample_id', key)} / 4294967296.0)"
    normal = lambda key: f"(round(sqrt(-2 * ln(({hashed.format('a.sample_id', '(' + key + chr(32) + '|| chr(97))')} + 1) / 4294967296.0)) * cos(2 * pi() * {hashed.format('a.sample_id', '(' + key + chr(32) + '|| chr(98))')} / 4294967296.0) * 1048576) / 1048576)"
    at = lambda what: f"('{what}' || a.site)"
    steps = """, link as materialized (select distinct s.sample_id, s.site, ((y + dy + l) % l) * l + (x + dx + l) % l as nb, (x + y) % 2 as side from site s, (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy))"""

    def sweeps(start: str, sums: str, new, coupling: str = "") -> str:
        """``sums`` are sums over neighbours b with coupling k.j; ``new(t)`` is the new state from these and a.s."""
        out, j = steps + coupling + f", z0 as materialized ({start})", "k.j" if coupling else "1"
        for t in range(2 * SWEEPS):
            out += f""", y{t} as (select a.sample_id, a.site, k.side, any_value(a.s) as s, {sums.replace('k.j', j)} from z{t} a join link k using (sample_id, site)
             {'join bond using (sample_id, site, nb)' if coupling else ''} join z{t} b on b.sample_id = a.sample_id and b.site = k.nb group by all),
             z{t + 1} as materialized (select sample_id, site, case when side = {t % 2} then {new(t)} else s end as s from y{t} a)"""
        return out

    last = f"z{2 * SWEEPS}"
    occ = "select sample_id, site, occ as s from site"
    spin, h = "(2 * a.s - 1)", f"{SIGMA} * " + normal(at("h"))
    coupling = ", bond as materialized (select a.sample_id, a.site, a.nb, " + normal("(least(a.site, a.nb) || '+' || greatest(a.site, a.nb))") + " as j from link a)"
    fields = "[" + ", ".join(normal(at(f"f{q}+")) for q in range(STATES)) + "]"
    gain = f"(w[q + 1] - w[a.s + 1] + {fields}[q + 1] - {fields}[a.s + 1])"
    potts = lambda t: f"(select case when {gain} >= 0 or {unit(at(f'm{t}+'))} < exp({BETA} * {gain}) then q else a.s end from (select cast(floor({STATES} * {unit(at(f'q{t}+'))}) as int) as q) p)"
    return {
        "constrained": sites + sweeps(occ, "sum(b.s) as w", lambda t: f"case when w = 0 then ({unit(at(f'k{t}+'))} < {RATE})::int else a.s end")
        + f" select sample_id, count(*) as n, sum(a.s) as n_set, sum((a.s <> occ)::int) as changed, sum((a.s <> occ)::int) > ceil(0.3 * count(*)) as new from {last} a join site using (sample_id, site) group by 1",
        "field_ising": sites + sweeps(occ, "sum(2 * b.s - 1) as w", lambda t: f"case when {unit(at(f'g{t}+'))} < 1 / (1 + exp({BETA} * -2 * {spin} * ({h} + w))) then 1 - a.s else a.s end")
        + f", e as (select a.sample_id, sum({spin} * (2 * b.s - 1)) / 2 as j from {last} a join link k using (sample_id, site) join {last} b on b.sample_id = a.sample_id and b.site = k.nb group by 1)"
        + f" select a.sample_id, count(*) as n, sum({spin}) as m, round((sum({spin} * {h}) + any_value(e.j)) / count(*), 6) as energy from {last} a join e using (sample_id) group by 1",
        "disordered_potts": sites + sweeps(f"select sample_id, site, cast(floor({STATES} * {unit(at('s'))}) as int) as s from site a", "[" + ", ".join(f"sum(case when b.s = {q} then bond.j else 0 end)" for q in range(STATES)) + "] as w", potts, coupling)
        + f", e as (select a.sample_id, sum(bond.j) / 2 as j from {last} a join bond using (sample_id, site) join {last} b on b.sample_id = a.sample_id and b.site = bond.nb and b.s = a.s group by 1)"
        + f", c as (select a.sample_id, count(*) as n, sum({fields}[a.s + 1]) as h, " + ", ".join(f"count(*) filter (s = {q}) as n{q}" for q in range(STATES)) + f" from {last} a group by 1)"
        + " select sample_id, n, round(-(j + h) / n, 6) as energy, round((greatest(n0, n1, n2) - least(n0, n1, n2)) / n, 9) as \"order\", n0, n1, n2 from c join e using (sample_id)",
        "cubic_rules": f"""with size as (select cast(floor(floor(cbrt(count(*)) + 1e-9) / 2) * 2 as bigint) as l, min(o_orderkey) as low from orders),
            u as (select o_orderkey - low as site, {hashed.format('0', "('c' || (o_orderkey - low))")} / 4294967296.0 as u, l from orders, size where o_orderkey - low < l * l * l),
            t as (select true as use_p, site, (u < 0.125)::int as occ, l from u union all select false, site, (u > 0.125)::int, l from u),
            p as (select use_p, occ, l, site, site % l as x, site // l % l as y, site // (l * l) as z from t),
            nb as (select distinct use_p, site, ((z + dz + l) % l * l + (y + dy + l) % l) * l + (x + dx + l) % l as nb from p, (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(dx, dy, dz)),
            k as (select a.use_p, a.site, any_value(a.occ) as occ, sum(coalesce(b.occ, 0)) as k from p a join nb on nb.use_p = a.use_p and nb.site = a.site left join p b on b.use_p = a.use_p and b.site = nb.nb group by 1, 2),
            c as (select a.use_p, a.site, any_value(a.occ) as occ, any_value(a.k) as k, sum((b.occ = 1 and b.k > 0)::int) as c from k a join nb on nb.use_p = a.use_p and nb.site = a.site join k b on b.use_p = a.use_p and b.site = nb.nb group by 1, 2)
            select use_p, count(*) as n, sum(occ) as n_occ, sum(k) as ends, sum((occ = 1 and k > 0)::int) as n_core, count(*) filter (c = 0) as n_active from c group by 1""",
    }
