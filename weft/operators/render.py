"""Writing a graph out and reading it back, and reports of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.operators.graph import confidence_distribution, god_nodes, graph_stats
from weft.operators.model import EDGES, NODES


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON lines, nodes in order of id and edges of (source, target, type), in files whose order is that of the rows."""
    nodes.select(*sorted(nodes.columns)).orderBy("id").write.mode("overwrite").json(f"{folder}/nodes")
    edges.select(*sorted(edges.columns)).orderBy("source", "target", "type").write.mode("overwrite").json(f"{folder}/edges")


def import_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`export_graph` wrote."""
    return spark.read.schema(NODES).json(f"{folder}/nodes"), spark.read.schema(EDGES).json(f"{folder}/edges")


def coverage_tag(covered: Column, errors: Column) -> Column:
    """A short tag: covered, uncovered or nothing where that is not known, and the number of errors."""
    cov = F.when(covered == 1, "covered").when(covered == 0, "uncovered")
    return F.concat_ws(", ", cov, F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" errors"))))


def report(nodes: DataFrame, edges: DataFrame, hotspots: DataFrame, limit: int = 10) -> str:
    """A summary in Markdown; only top rows and counts by type come to the driver."""
    out = ["# Graph report", ""]
    for r in graph_stats(nodes, edges).orderBy("metric", F.desc("n"), "key").where("metric <> 'nodes_by_project'").collect():
        out.append(f"- {r.metric}{'' if r.key is None else ' ' + r.key}: {r.n}")
    out += ["", "## Confidence", ""] + [f"- {r.label}: {r.n} ({r.percent} %)" for r in confidence_distribution(edges).orderBy("label").collect()]
    out += ["", "## Hubs", ""] + [f"- {r.id}: in {r.fan_in}, out {r.fan_out}" for r in god_nodes(nodes, edges, limit).collect()]
    out += ["", "## Hotspots", ""] + [f"- {r.id}: risk {r.risk}, churn {r.churn}" for r in hotspots.orderBy(F.desc("risk"), F.desc("id")).limit(limit).collect()]
    co = edges.where("type = 'co_changes_with' AND source < target").orderBy(F.desc("confidence"), "source", "target").limit(limit)
    out += ["", "## Change coupling", ""] + [f"- {r.source} and {r.target}: {r.confidence}" for r in co.collect()]
    return "\n".join(out) + "\n"
