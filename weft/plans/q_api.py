"""Queries through the directed questions, and around single symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.api import Graph
from weft.operators import deep, freshness as fr
from weft.plans.q_graph import NOW, edges, nodes
from weft.plans.q_history import TOUCHED, _dirty, _touched
from weft.session import table


def graph(s: SparkSession, d: str) -> Graph:
    return Graph(nodes(s, d), edges(s, d), _touched(s, d), table(s, d, "commits"))


def busiest(s: SparkSession, d: str) -> str:
    """The file with most commits."""
    top = _touched(s, d).groupBy("node").count().orderBy(F.desc("count"), "node").first()
    return top["node"] if top else ""


_BUSY = ", busy AS (SELECT node FROM churn ORDER BY churn DESC, node LIMIT 1)\n"


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return graph(s, d).decisions().withColumn("governs", F.array_join("governs", ","))


def _get(s: SparkSession, d: str) -> DataFrame:
    return graph(s, d).get(busiest(s, d)).select("id", "type", "churn", "fix_touches", "first_changed", "last_changed", F.array_join(F.transform(F.map_entries("authors"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("authors"))


def _matches(s: SparkSession, d: str) -> DataFrame:
    g = nodes(s, d).where("type = 'entity' AND name IS NOT NULL").select(F.substring_index("id", ":", -1).alias("entity"), F.array(F.lower("name"), F.lower(F.regexp_extract("name", "^[A-Z]?[a-z]+", 0))).alias("aliases"))
    return deep.alias_matches(nodes(s, d), g)


def _deep(s: SparkSession, d: str) -> DataFrame:
    """What changed with the busiest file in its whole history, and whether the graph knows it."""
    node = busiest(s, d)
    known = edges(s, d).where((F.col("source") == node) & (F.col("type") == "co_changes_with")).select(F.col("target").alias("id"))
    out = deep.deep_partners(_touched(s, d), table(s, d, "commits"), node, known, 2, 25)
    return out.select("other", "together", F.get("subjects", F.lit(0)).alias("latest"), "is_new")


def _freshness(s: SparkSession, d: str, cap: int) -> DataFrame:
    """Repositories are the projects of one kind (the part behind the hyphen), indexed a hundred days before the last
    indexing of each project."""
    indexed = table(s, d, "files").where("project IS NOT NULL").groupBy("project").agg(F.date_sub(F.to_date(F.max("indexed_at")), 100).alias("indexed_on"))
    head = table(s, d, "commits").where("sha IS NOT NULL AND project IS NOT NULL").groupBy("project").agg(F.max("sha").alias("head"))
    r = indexed.join(head, "project", "left").withColumn("repository", F.substring_index("project", "-", -1))
    out = fr.freshness(table(s, d, "commits"), _touched(s, d), r, _dirty(s, d), cap)
    return out.withColumn("banner", fr.banner(F.col("head_known"), F.col("behind"), F.col("capped"), F.col("n_dirty")))


QUERIES = {
    "freshness_report": lambda s, d: _freshness(s, d, 100),
    "freshness_commits": lambda s, d: _freshness(s, d, fr.MOST_COMMITS),
    "overview": lambda s, d: graph(s, d).overview(),
    "decisions_governed": _decisions,
    "get_node": _get,
    "history_card": lambda s, d: graph(s, d).history(busiest(s, d)),
    "working_set": lambda s, d: graph(s, d).working_set(_dirty(s, d)),
    "source_fragments": lambda s, d: deep.fragments(nodes(s, d), table(s, d, "sources")),
    "alias_matches": _matches,
    "deep_partners": _deep,
}

ORACLE = {
    "freshness_report": "WITH" + TOUCHED + """, ix AS (SELECT project, max(indexed_at)::DATE - 100 AS d FROM files WHERE project IS NOT NULL GROUP BY project), r AS (SELECT project, split_part(project, '-', -1) AS repository, d FROM ix),
ia AS (SELECT repository, min(d) AS indexed_on FROM r GROUP BY repository), late AS (SELECT DISTINCT repository, sha, node FROM touched JOIN c USING (sha) JOIN r ON r.project = split_part(node, '/', 1) JOIN ia USING (repository) WHERE date > indexed_on),
hd AS (SELECT DISTINCT repository FROM r JOIN commits USING (project) WHERE sha IS NOT NULL), b AS (SELECT repository, count(DISTINCT sha) AS n, count(DISTINCT node) AS f FROM late GROUP BY repository),
dirty AS (SELECT path FROM (SELECT path, content_hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS k FROM files) WHERE k = 1 AND content_hash IS NULL), dd AS (SELECT repository, count(*) AS n_dirty FROM dirty JOIN r ON r.project = split_part(path, '/', 1) GROUP BY repository),
x AS (SELECT repository, indexed_on, repository IN (SELECT repository FROM hd) AS head_known, least(coalesce(n, 0), 100) AS behind, coalesce(n, 0) > 100 AS capped, coalesce(f, 0) AS n_files_behind, coalesce(n_dirty, 0) AS n_dirty FROM ia LEFT JOIN b USING (repository) LEFT JOIN dd USING (repository))
SELECT *, CASE WHEN NOT head_known THEN 'history was rewritten: index again' ELSE nullif(concat_ws(', ', CASE WHEN behind > 0 THEN behind || CASE WHEN capped THEN '+' ELSE '' END || ' commits behind' END, CASE WHEN n_dirty > 0 THEN n_dirty || ' files changed' END), '') END AS banner FROM x""",
    "overview": NOW + """, st AS (SELECT project AS name, count(*) AS value, 'nodes_by_project' AS metric FROM n WHERE project IS NOT NULL GROUP BY project UNION ALL SELECT 'nodes', count(*), 'nodes' FROM n UNION ALL SELECT 'edges', count(*), 'edges' FROM e),
ends AS (SELECT name FROM n WHERE type = 'entity' AND list_contains(tags, 'endpoint') ORDER BY name LIMIT 25),
dg AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id), fl AS (SELECT n.id AS name, coalesce(d, 0) AS value FROM n LEFT JOIN dg USING (id) WHERE type = 'file' ORDER BY value DESC, name LIMIT 30)
SELECT 'totals' AS section, row_number() OVER (ORDER BY metric DESC, name)::INT AS rank, name, value FROM st UNION ALL SELECT 'endpoints', row_number() OVER (ORDER BY name)::INT, name, NULL FROM ends UNION ALL SELECT 'files', row_number() OVER (ORDER BY value DESC, name)::INT, name, value FROM fl""",
    "decisions_governed": NOW + """, g AS (SELECT DISTINCT e.source AS id, t.path FROM e JOIN n t ON t.id = e.target WHERE e.type = 'governs' AND t.path IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS k FROM g),
l AS (SELECT id, string_agg(path, ',' ORDER BY path) AS governs FROM k WHERE k <= 5 GROUP BY id)
SELECT n.id, type, name, summary, concat_ws(':', path, span_start::VARCHAR) AS location, coalesce(governs, '') AS governs FROM n LEFT JOIN l USING (id) WHERE type IN ('decision', 'convention')""",
    "get_node": NOW + "," + TOUCHED + _BUSY + """, own AS (SELECT touched.*, date, author, subject FROM touched LEFT JOIN c USING (sha) WHERE node = (SELECT node FROM busy)), au AS (SELECT author, count(*) AS k FROM own WHERE author IS NOT NULL GROUP BY author)
SELECT n.id, type, (SELECT count(*) FROM own) AS churn, (SELECT sum(CASE WHEN regexp_matches(coalesce(subject, ''), '(?i)\\b(fix(es|ed)?|bug(fix)?|hotfix|patch|revert)\\b') THEN 1 ELSE 0 END) FROM own)::BIGINT AS fix_touches, (SELECT min(date) FROM own) AS first_changed, (SELECT max(date) FROM own) AS last_changed, (SELECT string_agg(author || ':' || k, ',' ORDER BY author) FROM au) AS authors FROM n WHERE id = (SELECT node FROM busy)""",
    "history_card": "WITH" + TOUCHED + _BUSY + """, own AS (SELECT touched.sha, date, author, subject FROM touched JOIN c USING (sha) WHERE node = (SELECT node FROM busy)), au AS (SELECT author, count(*) AS n FROM own WHERE author IS NOT NULL GROUP BY author),
cm AS (SELECT *, row_number() OVER (ORDER BY date DESC NULLS LAST, sha DESC) AS r FROM own), pt AS (SELECT node, count(*) AS n FROM touched WHERE sha IN (SELECT sha FROM touched WHERE node = (SELECT node FROM busy)) AND node <> (SELECT node FROM busy) GROUP BY node ORDER BY n DESC, node LIMIT 5)
SELECT 'author' AS section, row_number() OVER (ORDER BY n DESC, author)::INT AS rank, author AS name, n, NULL::DATE AS day FROM au UNION ALL SELECT 'commit', r::INT, concat_ws(' ', sha, subject), NULL, date FROM cm WHERE r <= 3 UNION ALL SELECT 'partner', row_number() OVER (ORDER BY n DESC, node)::INT, node, n, NULL FROM pt""",
    "working_set": "WITH" + TOUCHED + """, h AS (SELECT node, max(date) AS last_changed FROM touched LEFT JOIN c USING (sha) GROUP BY node), dirty AS (SELECT path FROM (SELECT path, content_hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS k FROM files) WHERE k = 1 AND content_hash IS NULL),
r AS (SELECT node, last_changed FROM h WHERE last_changed IS NOT NULL AND node NOT IN (SELECT path FROM dirty) ORDER BY last_changed DESC, node LIMIT 20) SELECT 'dirty' AS state, path AS node, NULL::DATE AS last_changed FROM dirty UNION ALL SELECT 'recent', node, last_changed FROM r""",
    "source_fragments": NOW + r""", src AS (SELECT path, string_split(regexp_replace(max(text), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM sources WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path),
x AS (SELECT id, path, coalesce(span_start, 1) AS a, CASE WHEN span_start IS NULL THEN 60 ELSE coalesce(span_end - span_start + 1, 40) END AS k FROM n)
SELECT id, array_to_string(l[a:a + k - 1], chr(10)) AS fragment FROM x JOIN src USING (path) WHERE a >= 1 AND k >= 0""",
    "alias_matches": NOW + """, g AS (SELECT DISTINCT split_part(id, ':', -1) AS entity, unnest([lower(name), lower(regexp_extract(name, '^[A-Z]?[a-z]+'))]) AS alias FROM n WHERE type = 'entity' AND name IS NOT NULL)
SELECT entity, count(DISTINCT n.id) AS n FROM n JOIN g ON alias <> '' AND contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(path, ''))), alias) WHERE type IN ('symbol', 'file') GROUP BY entity""",
    "deep_partners": NOW + "," + TOUCHED + _BUSY + """, small AS (SELECT sha FROM touched GROUP BY sha HAVING count(*) BETWEEN 2 AND 25), own AS (SELECT sha FROM touched WHERE node = (SELECT node FROM busy) AND sha IN (SELECT sha FROM small)),
cc AS (SELECT sha, date, subject, row_number() OVER (PARTITION BY sha ORDER BY date DESC NULLS LAST, subject DESC NULLS LAST) AS k FROM commits WHERE sha IS NOT NULL), w AS (SELECT t.node AS other, t.sha, date, subject FROM touched t LEFT JOIN cc ON cc.sha = t.sha AND k = 1 WHERE t.sha IN (SELECT sha FROM own) AND node <> (SELECT node FROM busy)),
r AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY date DESC NULLS LAST, sha DESC) AS k, count(*) OVER (PARTITION BY other) AS together FROM w)
SELECT other, together, subject AS latest, other NOT IN (SELECT target FROM e WHERE source = (SELECT node FROM busy) AND type = 'co_changes_with') AS is_new FROM r WHERE k = 1 AND together >= 2""",
}
ORACLE["freshness_commits"] = ORACLE["freshness_report"].replace("least(coalesce(n, 0), 100)", f"least(coalesce(n, 0), {fr.MOST_COMMITS})").replace("coalesce(n, 0) > 100 AS", f"coalesce(n, 0) > {fr.MOST_COMMITS} AS")
