"""The queries of the general problems: changed records and references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators import incremental as inc, references as ref
from weft.session import table


def _p1(spark: SparkSession, d: str) -> DataFrame:
    files, nodes, runs = (table(spark, d, t) for t in ("files", "nodes", "index_runs"))
    states = inc.run_states(runs)
    written = nodes.where("type = 'file'").select(F.col("id").alias("key"), F.col("content_hash").alias("version"), inc.first_segment(F.col("id")).alias("project"), F.col("updated_at").alias("written_at"))
    source = files.select(F.col("path").alias("key"), F.col("content_hash").alias("version"), inc.first_segment(F.col("path")).alias("project"), F.col("indexed_at").alias("seen_at"))
    return inc.changed_records(source, inc.processed_ledger(written, states), inc.reread_from(states))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose current content no successful run has written."""
    return _p1(spark, d).select(F.col("key").alias("path"))


def p1_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Due paths per project: those the reread covers, and those that only the ledger still knows about."""
    return _p1(spark, d).groupBy("project").agg(F.sum((F.col("via") == "reread").cast("bigint")).alias("n_reread"), F.sum((F.col("via") == "late").cast("bigint")).alias("n_late"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return ref.orphan_edges(*(table(spark, d, t) for t in ("edges", "nodes", "removed_nodes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges with an endpoint that is not live."""
    return _p5(spark, d).select("source", "target", "type").distinct()


def p5_by_type_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per edge type and month."""
    return ref.orphan_report(_p5(spark, d))


_P1_SQL = """
WITH run_state AS (
  SELECT run_id, any_value(project) AS project, min(started_at) AS started_at, arg_max(finished_at, logged_at) AS finished_at, arg_max(status, logged_at) AS status
  FROM index_runs GROUP BY run_id),
owned AS (
  SELECT n.id AS path, n.content_hash AS h, n.updated_at AS t, s.status
  FROM (SELECT *, split_part(id, '/', 1) AS own FROM nodes WHERE type = 'file' AND updated_at IS NOT NULL) n
  ASOF JOIN run_state s ON n.own = s.project AND n.updated_at >= s.started_at),
done AS (SELECT path, max(struct_pack(t := t, h := h)).h AS h FROM owned WHERE status = 'success' GROUP BY path),
now AS (SELECT path, max(struct_pack(t := indexed_at, h := content_hash)) AS r FROM files GROUP BY path),
due AS (SELECT now.path, split_part(now.path, '/', 1) AS project, now.r.t AS t FROM now LEFT JOIN done USING (path) WHERE now.r.h IS NULL OR done.h IS NULL OR now.r.h <> done.h)
"""

_P5_SQL = """
WITH written AS (SELECT id, max(updated_at) AS w FROM nodes GROUP BY id),
gone AS (SELECT node_id, max(removed_at) AS r FROM removed_nodes GROUP BY node_id),
live AS (SELECT id FROM written LEFT JOIN gone ON id = node_id WHERE node_id IS NULL OR w > r),
orphans AS (
  SELECT e.*, s.id IS NULL AS sm, t.id IS NULL AS tm FROM edges e LEFT JOIN live s ON e.source = s.id LEFT JOIN live t ON e.target = t.id
  WHERE source IS NOT NULL AND target IS NOT NULL AND (s.id IS NULL OR t.id IS NULL))
"""

QUERIES = {"p1_found": p1_found, "p1_backlog": p1_backlog, "p5_found": p5_found, "p5_by_type_month": p5_by_type_month}

ORACLE = {
    "p1_found": _P1_SQL + "SELECT path FROM due",
    "p1_backlog": _P1_SQL + """, last AS (SELECT project, max(started_at) AS ls FROM run_state WHERE status = 'success' GROUP BY project),
bound AS (SELECT r.project, min(r.started_at) AS b FROM run_state r JOIN last USING (project) WHERE r.started_at <= ls AND (r.finished_at IS NULL OR r.finished_at >= ls) GROUP BY r.project)
SELECT due.project, sum(CASE WHEN b IS NULL OR t >= b THEN 1 ELSE 0 END)::BIGINT AS n_reread, sum(CASE WHEN t < b THEN 1 ELSE 0 END)::BIGINT AS n_late FROM due LEFT JOIN bound USING (project) GROUP BY due.project""",
    "p5_found": _P5_SQL + "SELECT DISTINCT source, target, type FROM orphans",
    "p5_by_type_month": _P5_SQL + """, keys AS (SELECT type, date_trunc('month', observed_at)::DATE AS month, source, target, count(*) AS n, max(sm::INT) AS s, max(tm::INT) AS t FROM orphans GROUP BY ALL)
SELECT type, month, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(s)::BIGINT AS n_missing_sources, sum(t)::BIGINT AS n_missing_targets FROM keys GROUP BY type, month""",
}
