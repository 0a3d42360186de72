"""Queries on directed graphs of lattice sites, on the core of their ground states, and on what forcing one site does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.functions.ranks import numbered
from latticework.jobs.inputs import active_clusters
from latticework.operators import closed_sets, digraph, lattice, pairing, responses

#: Share of the ways between neighbouring active sites that an arrow has, each direction by itself.
ARROWS = 0.6


def solved_lattices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Ground state of each active site of the lattices, their bonds, and the lattices' side."""
    own, n = active_clusters(spark, sf_dir)
    vertices, edges = lattice.bipartite_graph(written(own), n)
    edges = written(edges)
    return written(pairing.ground(vertices, edges)), edges, n


def _at(node: str, n: int) -> tuple[Column, Column]:
    """Sample and site number of a node."""
    return F.expr(f"cast({node} div {n * n} as int)"), F.col(node) % (n * n)


def _arrows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Active sites as nodes, with their cluster as the part that no arrow leaves, and arrows between neighbouring ones, by a hash of both."""
    own, n = active_clusters(spark, sf_dir)
    node = lambda c: (F.col("sample_id").cast("long") * (n * n) + F.col(c))
    own = written(own.select("sample_id", "site", node("cluster").alias("part"), (F.col("site") % n).alias("x"), F.expr(f"site div {n}").alias("y")))
    pairs = lattice.bonds(own, n).join(own.select("sample_id", F.col("site").alias("nb")), ["sample_id", "nb"]).select(node("site").alias("src"), node("nb").alias("dst"))
    return own.select(node("site").alias("node"), "part"), written(pairs.where(lattice.uniform(F.col("src"), F.col("dst")) < int(ARROWS * 2**32))), n


def _laid_out(components: DataFrame, dag: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """``(sample_id, component, weight, level, place, weak, weak_size)`` of each component: place numbers a sample's components from 0, predecessors first."""
    weights = written(components.groupBy("component").agg(F.count(F.lit(1)).alias("weight")))
    nodes = weights.select(F.col("component").alias("node"))
    weak = written(digraph.weak_components(dag, nodes, parts).withColumnRenamed("component", "weak"))
    sizes = weak.groupBy("weak").agg(F.count(F.lit(1)).alias("weak_size"))
    sample, site = _at("component", n)
    known = weights.join(digraph.levels(dag, nodes, parts).withColumnRenamed("node", "component"), "component").join(weak.withColumnRenamed("node", "component"), "component").join(sizes, "weak")
    rows = known.select(sample.alias("sample_id"), site.alias("component"), "weight", "level", _at("weak", n)[1].alias("weak"), "weak_size")
    return numbered(rows, ["sample_id"], ["level", "component"])


def digraph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the arrows with their number of sites and of components before and after each."""
    nodes, arrows, n = _arrows(spark, sf_dir)
    found = written(digraph.strong_components(arrows, nodes, nodes))
    dag = written(digraph.condensation(arrows, found))
    count = lambda c, name: dag.groupBy(F.col(c).alias("component")).agg(F.count(F.lit(1)).alias(name))
    weights = found.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    sample, site = _at("component", n)
    out = weights.join(count("dst", "before"), "component", "left").join(count("src", "after"), "component", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(sample.alias("sample_id"), site.alias("component"), "weight", none("before"), none("after"))


def digraph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the arrows in topological order, with their level and their weak component."""
    nodes, arrows, n = _arrows(spark, sf_dir)
    found = written(digraph.strong_components(arrows, nodes, nodes))
    return _laid_out(found, written(digraph.condensation(arrows, found)), nodes, n)


def _core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Strong components of the dependencies between undetermined matched pairs of the ground states, the acyclic graph between them, and the cluster of each site."""
    solved, edges, n = solved_lattices(spark, sf_dir)
    core, links = pairing.dependencies(solved, edges)
    links = written(links)
    parts = solved.select("node", F.col("cluster").alias("part"))
    found = written(digraph.strong_components(links, core, parts))
    return found, written(digraph.condensation(links, found)), parts, n


def core_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the ground states' undetermined pairs, in topological order."""
    return _laid_out(*_core(spark, sf_dir))


def ground_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample: undetermined pairs, their components and weak components, and the decimal logarithm of the exact number of ground states; also of the weak component with most."""
    found, dag, parts, n = _core(spark, sf_dir)
    nodes = written(found.select(F.col("component").alias("node")).distinct())
    weak = written(digraph.weak_components(dag, nodes, parts).withColumnRenamed("component", "weak"))
    sample = lambda c: _at(c, n)[0].alias("sample_id")
    own = closed_sets.counts(weak, dag).groupBy(sample("weak")).agg(F.sum("nodes").alias("components"), F.count(F.lit(1)).alias("weak_components"), F.round(F.sum("log10_states"), 6).alias("log10_states"), F.max_by("states", F.struct("log10_states", "weak")).alias("most_states"))
    return found.groupBy(sample("component")).agg(F.count(F.lit(1)).alias("pairs")).join(own, "sample_id")


def core_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample and size of the weak component (up to 16 components): number of closed states, by how many components they hold."""
    found, dag, parts, n = _core(spark, sf_dir)
    weak = written(digraph.weak_components(dag, found.select(F.col("component").alias("node")).distinct(), parts).withColumnRenamed("component", "weak"))
    sizes = weak.groupBy("weak").agg(F.count(F.lit(1)).alias("components"))
    states = closed_sets.states(weak, dag, 16).join(sizes, "weak")
    return states.groupBy(_at("weak", n)[0].alias("sample_id"), "components", "size").agg(F.count(F.lit(1)).alias("states"))


def drawn_ground_states(spark: SparkSession, sf_dir: str, draws: int = 16) -> DataFrame:
    """By sample and draw, of ground states drawn with equal probability: sites of side 0 and of side 1 in the state, and their shares' difference R."""
    solved, edges, n = solved_lattices(spark, sf_dir)
    core, links = pairing.dependencies(solved, edges)
    links, parts = written(links), solved.select("node", F.col("cluster").alias("part"))
    found = written(digraph.strong_components(links, core, parts))
    dag = written(digraph.condensation(links, found))
    weak = written(digraph.weak_components(dag, found.select(F.col("component").alias("node")).distinct(), parts).withColumnRenamed("component", "weak"))
    weights = found.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    sample = lambda c: _at(c, n)[0].alias("sample_id")
    # A pair depends on the pairs at the neighbours of its vertex of side 0: that vertex is in the state only if theirs are, so a closed set holds the pairs whose vertex of side 1 is in.
    inside = closed_sets.samples(weak, dag, draws).join(weights.withColumnRenamed("component", "node"), "node").groupBy(sample("node"), "draw").agg(F.sum("weight").alias("k"))
    fixed = solved.groupBy(sample("node")).agg(
        *[F.count_if(F.expr(f"side = {p}")).alias(f"n_{q}") for p, q in ((0, "a"), (1, "b"))], *[F.count_if(F.expr(f"side = {p} and state = 1")).alias(f"in_{q}") for p, q in ((0, "a"), (1, "b"))],
        F.count_if(F.expr("side = 0 and state is null")).alias("pairs"), F.count_if(F.col("mis") == 1).alias("size"),
    )
    every = fixed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).join(inside, ["sample_id", "draw"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    a, b = F.col("in_a") + F.col("pairs") - F.col("k"), F.col("in_b") + F.col("k")
    share = lambda x, c: F.coalesce(F.try_divide(x, F.col(c)), F.lit(0.0))
    return every.select("sample_id", "draw", a.alias("a"), b.alias("b"), "size", F.round(share(a, "n_a") - share(b, "n_b"), 9).alias("r"))


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    solved, edges, n = solved_lattices(spark, sf_dir)
    sizes = solved.groupBy(_at("cluster", n)[0].alias("s"), "cluster").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("s").agg(F.max_by("cluster", F.struct("k", -F.col("cluster"))).alias("cluster")).select("cluster", F.lit(True).alias("in_largest"))
    # One row a sample.
    return responses.site_responses(solved, edges).join(largest, "cluster", "left").withColumn("in_largest", F.coalesce("in_largest", F.lit(False))), n


def site_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each active site: its place in the ground state, how many sites change when it is forced out or in, by how much the ground state is smaller, and whether it is in the largest cluster."""
    found, n = _responses(spark, sf_dir)
    sample, site = _at("node", n)
    return found.select(sample.alias("sample_id"), site.alias("site"), F.col("mis").alias("occupation"), F.col("changed").alias("change_number"), F.col("shift").alias("change_energy"), "in_largest")


def response_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample, of all sites and of those in the largest cluster: shares of zero responses, of others on occupied and on empty sites; mean and deviation of both changes."""
    found = written(site_responses(spark, sf_dir))
    both = found.withColumn("largest", F.lit(False)).unionByName(found.where("in_largest").withColumn("largest", F.lit(True)))
    share = lambda test: F.round(F.avg(F.expr(test).cast("double")), 9)
    moments = [x for c, k in (("change_number", "number"), ("change_energy", "energy")) for x in (F.round(F.avg(c), 9).alias(f"mean_{k}"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 9).alias(f"sd_{k}"))]
    return both.groupBy("sample_id", "largest").agg(
        F.count(F.lit(1)).alias("n"), share("change_energy = 0").alias("zero"), share("change_energy <> 0 and occupation = 1").alias("other_occupied"), share("change_energy <> 0 and occupation = 0").alias("other_empty"), *moments
    )


def response_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all samples, one row: points, shares without and with a preference, mean changes with their deviation over the samples, and the same of the largest clusters."""
    report = written(response_report(spark, sf_dir))
    mean = lambda c, where: F.round(F.coalesce(F.avg(F.when(F.col("largest") == where, F.col(c))), F.lit(0.0)), 9)
    deviation = lambda c: F.round(F.coalesce(F.stddev_samp(F.when(~F.col("largest"), F.col(c))), F.lit(0.0)), 9)
    shares = [("zero", "no_preference"), ("other_occupied", "prefers_occupied"), ("other_empty", "prefers_empty")]
    return report.agg(
        F.count_if(~F.col("largest")).alias("samples"), F.sum(F.when(~F.col("largest"), F.col("n"))).alias("points"), *[mean(c, False).alias(k) for c, k in shares],
        *[x for c in ("number", "energy") for x in (mean(f"mean_{c}", False).alias(f"mean_{c}"), deviation(f"mean_{c}").alias(f"sd_{c}"))],
        mean("n", True).alias("largest_size"), *[mean(c, True).alias(f"largest_{k}") for c, k in shares],
    )


QUERIES = {q.__name__: q for q in (digraph_components, digraph_levels, core_decomposition, ground_state_counts, core_states, drawn_ground_states, site_responses, response_report, response_summary)}


def oracles(clusters: str, hashed: str) -> dict[str, str]:
    """SQL for an independent engine, given its clusters and its hash: reachability as a closed table of pairs."""
    node = "a.sample_id * l.l * l.l + {}"
    base = clusters + f""",
     arrow as materialized (select a.sample_id, a.site as src, a.nb as dst from pair a, size l where {hashed.format(node.format('a.site'), node.format('a.nb'))} < {int(ARROWS * 2**32)}),
     reach(sample_id, a, b) as (select sample_id, src, dst from arrow union select r.sample_id, r.a, e.dst from reach r join arrow e on e.sample_id = r.sample_id and e.src = r.b),
     mutual as materialized (select r.sample_id, r.a, min(r.b) as least from reach r join reach q on q.sample_id = r.sample_id and q.a = r.b and q.b = r.a group by 1, 2),
     comp as materialized (select s.sample_id, s.site, least(s.site, coalesce(m.least, s.site)) as component from ruled s left join mutual m on m.sample_id = s.sample_id and m.a = s.site where s.active = 1),
     weight as materialized (select sample_id, component, count(*) as weight from comp group by 1, 2),
     dag as materialized (select distinct a.sample_id, c.component as src, d.component as dst from arrow a join comp c on c.sample_id = a.sample_id and c.site = a.src join comp d on d.sample_id = a.sample_id and d.site = a.dst where c.component <> d.component)"""
    levels = base + """,
     lv(sample_id, component, level) as (select sample_id, component, 0 from weight w where not exists (select 1 from dag d where d.sample_id = w.sample_id and d.dst = w.component)
      union select v.sample_id, d.dst, v.level + 1 from lv v join dag d on d.sample_id = v.sample_id and d.src = v.component),
     level as (select sample_id, component, max(level) as level from lv group by 1, 2),
     either as materialized (select sample_id, src, dst from dag union select sample_id, dst, src from dag),
     wc(sample_id, component, label) using key (sample_id, component) as (select sample_id, component, component from weight
      union (select p.sample_id, p.src, min(c.label) from either p join wc c on c.sample_id = p.sample_id and c.component = p.dst join recurring.wc r on r.sample_id = p.sample_id and r.component = p.src
       where c.label < r.label group by p.sample_id, p.src))"""
    return {
        "digraph_components": base + """ select sample_id, component, weight, (select count(*) from dag d where d.sample_id = w.sample_id and d.dst = w.component) as before, (select count(*) from dag d where d.sample_id = w.sample_id and d.src = w.component) as after from weight w""",
        "digraph_levels": levels + """ select sample_id, component, weight, level, row_number() over (partition by sample_id order by level, component) - 1 as place, label as weak, count(*) over (partition by sample_id, label) as weak_size
         from weight join level using (sample_id, component) join wc using (sample_id, component)""",
    }
