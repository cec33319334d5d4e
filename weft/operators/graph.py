"""Graph operators: statistics, degrees, hubs, neighbourhoods, impact, lifting and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from weft.session import cut
from weft.operators.model import STRUCTURAL, confidence_label

# Least degree of a hub, and the standard deviations above the mean.
HUB_FLOOR, HUB_SIGMAS = 3.0, 2.0
# Node types that are no hubs.
NO_HUBS = ("external", "decision", "convention", "entity", "doc")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, n): nodes by type and by project, edges by type, and both totals, from one pass over each."""
    n = nodes.groupBy("type", "project").count()
    n = n.groupingSets([["type"], ["project"], []], "type", "project").agg(F.sum("count").alias("n"), F.grouping("type").alias("gt"), F.grouping("project").alias("gp"))
    n = n.select(F.when(F.col("gt") == 0, "nodes_by_type").when(F.col("gp") == 0, "nodes_by_project").otherwise("nodes").alias("metric"), F.when(F.col("gt") == 0, F.col("type")).when(F.col("gp") == 0, F.col("project")).alias("key"), "n")
    e = edges.rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("g")).select(F.when(F.col("g") == 0, "edges_by_type").otherwise("edges").alias("metric"), F.col("type").alias("key"), "n")
    return n.unionByName(e)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): incoming and outgoing edges of all types."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, kind: str = "file", scope: str | None = None, limit: int = 30) -> DataFrame:
    """The ``limit`` nodes of a type with the greatest degree (ties by id), those without edges included."""
    these = nodes.where(F.col("type") == kind)
    if scope:
        these = these.where(F.col("path").contains(scope))
    out = these.select("id", "name").join(degrees(edges), "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    return out.orderBy(F.desc("degree"), "id").limit(limit)


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over structural edges."""
    s = edges.where(F.col("type").isin(*STRUCTURAL))
    ends = s.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(s.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").cast("bigint").alias("fan_in"), F.sum("o").cast("bigint").alias("fan_out"))


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """Nodes whose fan-in or fan-out is at least the mean plus two standard deviations (and at least 3) over all
    eligible nodes, unconnected ones included. (id, fan_in, fan_out, score, reason), greatest score and id first."""
    those = nodes.where(~F.col("type").isin(*NO_HUBS)).select("id")
    both = those.join(fan_in_out(edges), "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    limits = both.agg(*(F.greatest(F.lit(HUB_FLOOR), F.avg(c) + HUB_SIGMAS * F.stddev_pop(c)).alias(f"least_{c}") for c in ("fan_in", "fan_out")))
    both = both.withColumn("least_in", limits.select("least_fan_in").scalar()).withColumn("least_out", limits.select("least_fan_out").scalar())
    by_in, by_out = F.col("fan_in") >= F.col("least_in"), F.col("fan_out") >= F.col("least_out")
    out = both.where(by_in | by_out).select("id", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).alias("score"), F.when(by_in, "fan_in").otherwise("fan_out").alias("reason"))
    return out if limit is None else out.orderBy(F.desc("score"), F.desc("id")).limit(limit)


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, edge_types: list[str] | None = None, limit: int | None = 40) -> DataFrame:
    """One hop out of and into a node: (direction, type, other, name, label). A node that is not in the graph has its
    id for a name. Two filtered reads instead of one with OR, so that each is pushed to the scan."""
    out = edges.where(F.col("source") == node_id).select(F.lit("out").alias("direction"), "type", F.col("target").alias("other"), "provenance", "confidence")
    into = edges.where(F.col("target") == node_id).select(F.lit("in").alias("direction"), "type", F.col("source").alias("other"), "provenance", "confidence")
    both = out.unionByName(into)
    if edge_types:
        both = both.where(F.col("type").isin(*edge_types))
    named = both.join(nodes.select(F.col("id").alias("__id"), "name"), F.col("other") == F.col("__id"), "left")
    rows = named.select("direction", "type", "other", F.coalesce("name", "other").alias("name"), confidence_label(F.col("type"), F.col("provenance"), F.col("confidence")).alias("label"))
    if limit is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("direction").orderBy("type", "other"))).where(F.col("__n") <= limit).drop("__n")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(id, depth, reasons): what depends on the seeds within ``depth`` steps, by incoming structural edges and by
    co-change in either direction, with the sorted distinct reasons met at any step.

    One join a step; only newly met nodes go on, so that cycles end, and nothing is joined once none are left. Each level is
    written to the shared folder, so that the plan of a level does not hold those before it."""
    inward = edges.where(F.col("type").isin(*STRUCTURAL)).select(F.col("target").alias("__at"), F.col("source").alias("id"), F.col("type").alias("reason"))
    co = edges.where("type = 'co_changes_with'")
    steps = inward.unionByName(co.select(F.col("source").alias("__at"), F.col("target").alias("id"), F.col("type").alias("reason"))).unionByName(co.select(F.col("target").alias("__at"), F.col("source").alias("id"), F.col("type").alias("reason"))).distinct()
    seeds = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct()
    seen, front, found = seeds, seeds, None
    for level in range(1, max(1, depth) + 1):
        met = front.select(F.col("id").alias("__at")).join(steps, "__at").select("id", "reason", F.lit(level).alias("depth")).distinct()
        if level < depth:
            met = cut(met)
            front = cut(met.select("id").distinct().join(seen, "id", "left_anti"))
            seen = seen.unionByName(front)
        found = met if found is None else found.unionByName(met)
        if level < depth and front.isEmpty():
            break
    found = found.join(seeds, "id", "left_anti")
    return found.groupBy("id").agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def confidence_distribution(edges: DataFrame) -> DataFrame:
    """(label, n, percent) for the three labels, those without edges included."""
    label = confidence_label(F.col("type"), F.col("provenance"), F.col("confidence")).alias("label")
    none = edges.sparkSession.createDataFrame([("EXTRACTED",), ("INFERRED",), ("AMBIGUOUS",)], "label string").withColumn("n", F.lit(0).cast("bigint"))
    n = edges.groupBy(label).agg(F.count("*").alias("n")).unionByName(none).groupBy("label").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return n.select("label", "n", F.coalesce(F.floor(100 * F.col("n") / F.when(total > 0, total)), F.lit(0)).alias("percent"))


def lift_to_files(nodes: DataFrame, edges: DataFrame, limit: int = 400) -> DataFrame:
    """(source, target, type, weight): edges between the files of their ends, without loops, counted, within the
    ``limit`` files of the greatest weighted degree (ties by id)."""
    home = nodes.select(F.col("id").alias("__id"), F.coalesce("path", "id").alias("__file"))
    s, t = home.select(F.col("__id").alias("__s"), F.col("__file").alias("a")), home.select(F.col("__id").alias("__t"), F.col("__file").alias("b"))
    links = edges.join(s, F.col("source") == F.col("__s")).join(t, F.col("target") == F.col("__t")).where("a <> b").groupBy(F.col("a").alias("source"), F.col("b").alias("target"), "type").agg(F.count("*").alias("weight"))
    ends = links.select(F.col("source").alias("id"), "weight").unionByName(links.select(F.col("target").alias("id"), "weight"))
    top = ends.groupBy("id").agg(F.sum("weight").alias("d")).orderBy(F.desc("d"), "id").limit(limit).select("id")
    return links.join(top.select(F.col("id").alias("source")), "source", "left_semi").join(top.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "type", "weight")


def reconcile(nodes: DataFrame, edges: DataFrame, before: DataFrame) -> DataFrame:
    """Edges after a move: an end that is gone goes to the one node that now has the name and signature the end had
    (``before``: id, name, signature); an edge with an end that finds none is dropped. (source, target, type, moved)."""
    here = nodes.where("type = 'symbol'").groupBy("name", F.coalesce("signature", F.lit("")).alias("sig")).agg(F.count("*").alias("n"), F.min("id").alias("now")).where("n = 1")
    gone = before.join(nodes.select("id"), "id", "left_anti").select("id", "name", F.coalesce("signature", F.lit("")).alias("sig"))
    moved = gone.join(here, ["name", "sig"]).select("id", "now")
    alive = nodes.select("id", F.col("id").alias("now"))
    to = alive.unionByName(moved)
    s, t = to.select(F.col("id").alias("source"), F.col("now").alias("__s")), to.select(F.col("id").alias("target"), F.col("now").alias("__t"))
    out = edges.join(s, "source").join(t, "target")
    return out.select(F.col("__s").alias("source"), F.col("__t").alias("target"), "type", ((F.col("source") != F.col("__s")) | (F.col("target") != F.col("__t"))).alias("moved")).distinct()


def unique_candidates(calls: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Calls joined to their definition where exactly one distinct definition has the keys; the rest gets no edge."""
    one = definitions.groupBy(*keys).agg(F.count_distinct("id").alias("__n"), F.min("id").alias("target")).where("__n = 1").drop("__n")
    return calls.join(one, keys)


def deep_suggestions(nodes: DataFrame, edges: DataFrame, churn: DataFrame, least: int = 5) -> DataFrame:
    """(id, churn): symbols without co-change edges in files that change often, for which full history may tell more.
    ``churn`` has node_id and churn."""
    linked = edges.where("type = 'co_changes_with'").select(F.col("source").alias("id")).distinct()
    c = churn.groupBy(F.col("node_id").alias("path")).agg(F.max("churn").alias("churn")).where(F.col("churn") >= least)
    return nodes.where("type = 'symbol' AND path IS NOT NULL").select("id", "path").join(c, "path").join(linked, "id", "left_anti").select("id", "churn")
