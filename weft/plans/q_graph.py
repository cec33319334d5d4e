"""Graph queries over the current rows of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators import graph as g, model as m
from weft.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return m.current_nodes(table(spark, d, "nodes"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return m.current_edges(table(spark, d, "edges"))


#: The current rows, in SQL.
NOW = """
WITH n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1),
e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY observed_at DESC NULLS LAST, confidence DESC NULLS LAST, provenance DESC NULLS LAST) AS rn
      FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL) WHERE rn = 1)
"""
LABEL = """CASE WHEN regexp_matches(lower(coalesce(provenance, '')), 'heuristic|guess|ambiguous|fuzzy') THEN 'AMBIGUOUS'
WHEN contains(lower(coalesce(provenance, '')), 'coverage') THEN 'EXTRACTED'
WHEN type IN ('co_changes_with', 'tested_by', 'models', 'references', 'relates_to') THEN CASE WHEN coalesce(confidence, 1.0) < 0.4 THEN 'AMBIGUOUS' ELSE 'INFERRED' END
WHEN type IN ('calls', 'imports', 'defines', 'depends_on', 'implements', 'decided_because', 'governs') THEN 'EXTRACTED' ELSE 'INFERRED' END"""
_FAN = """, s AS (SELECT * FROM e WHERE type IN ('calls', 'imports', 'depends_on', 'references')),
i AS (SELECT target AS id, count(*) AS fan_in FROM s GROUP BY 1), o AS (SELECT source AS id, count(*) AS fan_out FROM s GROUP BY 1)
"""
_STEPS = """, steps AS (SELECT DISTINCT target AS src, source AS dst, type AS reason FROM e WHERE type IN ('calls', 'imports', 'depends_on', 'references')
UNION SELECT source, target, type FROM e WHERE type = 'co_changes_with' UNION SELECT target, source, type FROM e WHERE type = 'co_changes_with')
"""


def hot_target(spark: SparkSession, d: str) -> DataFrame:
    """The file most edges lead to, as a seed."""
    e = edges(spark, d).join(nodes(spark, d).where("type = 'file'").select(F.col("id").alias("target")), "target", "left_semi")
    return e.groupBy("target").count().orderBy(F.desc("count"), "target").limit(1).select(F.col("target").alias("id"))


_SEED = """, seed AS (SELECT e.target AS id FROM e JOIN n ON n.id = e.target AND n.type = 'file' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
"""


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    seed = hot_target(spark, d).first()
    return g.neighbors(nodes(spark, d), edges(spark, d), seed.id if seed else "", limit=40)


def _impact(spark: SparkSession, d: str) -> DataFrame:
    out = g.impact(edges(spark, d), hot_target(spark, d), 2)
    return out.select("id", "depth", F.array_join("reasons", ",").alias("reasons"))


def _reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that were removed and not written again are gone; their names and signatures lead to where they are now."""
    removed = table(spark, d, "removed_nodes").groupBy("node_id").agg(F.max("removed_at").alias("r"))
    n = nodes(spark, d)
    live = n.join(removed, n.id == removed.node_id, "left").where("node_id IS NULL OR updated_at > r").drop("node_id", "r")
    return g.reconcile(live, edges(spark, d).select("source", "target", "type"), n.where("type = 'symbol'").select("id", "name", "signature"))


def _unique(spark: SparkSession, d: str) -> DataFrame:
    """Names that symbols of one project call, resolved where one symbol of the project has that name."""
    n = nodes(spark, d).where("type = 'symbol' AND name IS NOT NULL").select("id", "name", F.substring_index("id", "/", 1).alias("project"))
    calls = n.select("project", "name").distinct()
    return g.unique_candidates(calls, n, ["project", "name"])


QUERIES = {
    "graph_stats": lambda s, d: g.graph_stats(nodes(s, d), edges(s, d)),
    "upsert_last_writer": lambda s, d: edges(s, d).select("source", "target", "type", "confidence", "provenance"),
    "degree_hubs": lambda s, d: g.hubs(nodes(s, d), edges(s, d)),
    "fan_in_out": lambda s, d: g.fan_in_out(edges(s, d)),
    "god_nodes": lambda s, d: g.god_nodes(nodes(s, d), edges(s, d), None),
    "neighbors_out_in": _neighbors,
    "impact_bfs": _impact,
    "confidence_distribution": lambda s, d: g.confidence_distribution(edges(s, d)),
    "viz_lift": lambda s, d: g.lift_to_files(nodes(s, d), edges(s, d)),
    "reconcile_moved": _reconcile,
    "unique_candidate_link": _unique,
    "orphan_prune": lambda s, d: m.keep_by(table(s, d, "git_node").select("node_id", "churn"), nodes(s, d).select("id"), ["node_id"]),
    "deep_suggestions": lambda s, d: g.deep_suggestions(nodes(s, d), edges(s, d), table(s, d, "git_node").where("node_id IS NOT NULL")),
}

ORACLE = {
    "graph_stats": NOW + """SELECT 'nodes_by_type' AS metric, type AS key, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'nodes_by_project', project, count(*) FROM n GROUP BY project UNION ALL SELECT 'nodes', NULL, count(*) FROM n
UNION ALL SELECT 'edges_by_type', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'edges', NULL, count(*) FROM e""",
    "upsert_last_writer": NOW + "SELECT source, target, type, confidence, provenance FROM e",
    "degree_hubs": NOW + ", x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e), y AS (SELECT id, count(*) AS d FROM x GROUP BY id) SELECT n.id, name, coalesce(d, 0) AS degree FROM n LEFT JOIN y USING (id) WHERE type = 'file' ORDER BY degree DESC, n.id LIMIT 30",
    "fan_in_out": NOW + _FAN + "SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o USING (id)",
    "god_nodes": NOW + _FAN + """, b AS (SELECT n.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) WHERE type NOT IN ('external', 'decision', 'convention', 'entity', 'doc')),
l AS (SELECT greatest(3.0, avg(fan_in) + 2 * stddev_pop(fan_in)) AS li, greatest(3.0, avg(fan_out) + 2 * stddev_pop(fan_out)) AS lo FROM b)
SELECT id, fan_in, fan_out, fan_in + fan_out AS score, CASE WHEN fan_in >= li THEN 'fan_in' ELSE 'fan_out' END AS reason FROM b, l WHERE fan_in >= li OR fan_out >= lo""",
    "neighbors_out_in": NOW + _SEED + f""", x AS (SELECT 'out' AS direction, type, target AS other, {LABEL} AS label FROM e WHERE source = (SELECT id FROM seed) UNION ALL SELECT 'in', type, source, {LABEL} FROM e WHERE target = (SELECT id FROM seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY type, other) AS k FROM x)
SELECT direction, r.type, other, coalesce(name, other) AS name, label FROM r LEFT JOIN n ON n.id = other WHERE k <= 40""",
    "impact_bfs": NOW + _SEED + _STEPS + """, one AS (SELECT dst AS id, reason, 1 AS depth FROM steps WHERE src = (SELECT id FROM seed)),
two AS (SELECT dst, reason, 2 FROM steps WHERE src IN (SELECT id FROM one WHERE id <> (SELECT id FROM seed))),
hit AS (SELECT * FROM one UNION SELECT * FROM two)
SELECT id, min(depth)::INT AS depth, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM hit WHERE id <> (SELECT id FROM seed) GROUP BY id""",
    "confidence_distribution": NOW + f", x AS (SELECT {LABEL} AS label, 1 AS one FROM e UNION ALL SELECT unnest(['EXTRACTED', 'INFERRED', 'AMBIGUOUS']), 0) SELECT label, sum(one)::BIGINT AS n, coalesce(floor(100 * sum(one) / sum(sum(one)) OVER ()), 0)::BIGINT AS percent FROM x GROUP BY label",
    "viz_lift": NOW + """, l AS (SELECT coalesce(a.path, a.id) AS source, coalesce(b.path, b.id) AS target, e.type, count(*) AS weight FROM e JOIN n a ON e.source = a.id JOIN n b ON e.target = b.id WHERE coalesce(a.path, a.id) <> coalesce(b.path, b.id) GROUP BY ALL),
x AS (SELECT source AS id, weight FROM l UNION ALL SELECT target, weight FROM l), top AS (SELECT id FROM x GROUP BY id ORDER BY sum(weight) DESC, id LIMIT 400)
SELECT * FROM l WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)""",
    "reconcile_moved": NOW + """, gone AS (SELECT node_id, max(removed_at) AS r FROM removed_nodes GROUP BY node_id),
live AS (SELECT n.* FROM n LEFT JOIN gone ON id = node_id WHERE node_id IS NULL OR updated_at > r),
here AS (SELECT name, coalesce(signature, '') AS sig, min(id) AS now FROM live WHERE type = 'symbol' GROUP BY ALL HAVING count(*) = 1),
moved AS (SELECT n.id, here.now FROM n JOIN here ON n.name = here.name AND coalesce(n.signature, '') = sig WHERE n.type = 'symbol' AND n.id NOT IN (SELECT id FROM live)),
too AS (SELECT id, id AS now FROM live UNION ALL SELECT id, now FROM moved)
SELECT DISTINCT s.now AS source, t.now AS target, e.type, (e.source <> s.now OR e.target <> t.now) AS moved FROM e JOIN too s ON e.source = s.id JOIN too t ON e.target = t.id""",
    "unique_candidate_link": NOW + ", x AS (SELECT id, name, split_part(id, '/', 1) AS project FROM n WHERE type = 'symbol' AND name IS NOT NULL) SELECT project, name, min(id) AS target FROM x GROUP BY ALL HAVING count(DISTINCT id) = 1",
    "orphan_prune": "SELECT node_id, churn FROM git_node WHERE node_id IN (SELECT id FROM nodes)",
    "deep_suggestions": NOW + ", c AS (SELECT node_id AS path, max(churn) AS churn FROM git_node GROUP BY 1 HAVING max(churn) >= 5) SELECT id, churn FROM n JOIN c USING (path) WHERE type = 'symbol' AND id NOT IN (SELECT source FROM e WHERE type = 'co_changes_with')",
}
