"""Queries over history, tests and tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weft.operators import runtime as r, temporal as t
from weft.operators.model import confidence_label, merge_columns
from weft.plans.q_graph import LABEL, NOW, edges, nodes
from weft.session import table


def tidy(path):
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"^\./", "")


def _touched(s: SparkSession, d: str) -> DataFrame:
    return t.touches(table(s, d, "commit_files"), tidy(F.col("new_path")))


def _files(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).where("type = 'file'").select("id")


def _cochange(s: SparkSession, d: str) -> DataFrame:
    e = t.co_change_edges(_touched(s, d), _files(s, d))
    return e.withColumn("label", confidence_label(F.col("type"), F.col("provenance"), F.col("confidence")))


def _related(s: SparkSession, d: str) -> DataFrame:
    """Pairs of projects with an edge between them."""
    a, b = F.substring_index("source", "/", 1), F.substring_index("target", "/", 1)
    e = edges(s, d).where("contains(source, '/') AND contains(target, '/') AND type IN ('co_changes_with', 'references', 'imports', 'calls')")
    return e.select(F.least(a, b).alias("project_a"), F.greatest(a, b).alias("project_b")).where("project_a <> project_b").distinct()


def _author_days(s: SparkSession, d: str) -> DataFrame:
    """Packages that one author touched on one day, as commits that reach over projects."""
    c = table(s, d, "commits").where("sha IS NOT NULL AND author IS NOT NULL AND date IS NOT NULL").select("sha", "author", "date").distinct()
    return _touched(s, d).join(c, "sha").select(F.concat_ws("@", "author", F.col("date").cast("string")).alias("sha"), F.substring_index("node", "/", 2).alias("node")).distinct()


def _history(s: SparkSession, d: str) -> DataFrame:
    return t.node_history(_touched(s, d), table(s, d, "commits"))


def _node_history(s: SparkSession, d: str) -> DataFrame:
    listed = F.array_join(F.transform(F.map_entries("authors"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return _history(s, d).withColumn("authors", listed)


def _covered(s: SparkSession, d: str) -> DataFrame:
    """Files that a test imports are covered, other files with tests in their package are not, the rest is unknown."""
    by = r.tested_by_import(edges(s, d), _files(s, d)).select(F.col("source").alias("id")).distinct().withColumn("hit", F.lit(1))
    pkg = lambda c: F.substring_index(c, "/", 2)
    tests = _files(s, d).where(r.is_test_path(F.col("id"))).select(pkg("id").alias("pkg")).distinct().withColumn("has", F.lit(1))
    f = _files(s, d).withColumn("pkg", pkg("id")).join(by, "id", "left").join(tests, "pkg", "left")
    return f.select("id", F.when(F.col("hit") == 1, 1).when(F.col("has") == 1, 0).alias("covered"))


def _dirty(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "files").groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("l"))
    return last.where("l.content_hash IS NULL").select(F.col("path").alias("node"))


def _behind(s: SparkSession, d: str) -> DataFrame:
    """Against a watermark a hundred days before the last indexing of each project."""
    indexed = table(s, d, "files").where("project IS NOT NULL").groupBy("project").agg(F.date_sub(F.to_date(F.max("indexed_at")), 100).alias("indexed_on"))
    return t.commits_behind(table(s, d, "commits"), _touched(s, d), indexed)


def _ages(s: SparkSession, d: str) -> DataFrame:
    today = table(s, d, "commits").agg(F.max("date").alias("m")).scalar()
    return _history(s, d).where("first_changed IS NOT NULL").select("node", t.age_days(F.col("first_changed"), today).alias("age_days"))


def _themes(s: SparkSession, d: str) -> DataFrame:
    touched = _touched(s, d)
    pairs = t.co_changes(touched).where(F.col("together") >= t.MIN_TOGETHER)
    return t.themes(pairs, t.top_commits(touched, table(s, d, "commits")))


def _renames(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "commit_files")
    return t.rename_targets(f.select(tidy(F.col("old_path")).alias("old_path"), tidy(F.col("new_path")).alias("new_path")))


def _commits_since(s: SparkSession, d: str) -> DataFrame:
    """Commits newer than the last one before April 2025 of each project; those of projects whose name ends in b have lost it."""
    c = table(s, d, "commits")
    heads = c.where("date < '2025-04-01' AND sha IS NOT NULL").groupBy("project").agg(F.max(F.struct("seq", "sha")).alias("h")).select("project", F.when(F.col("project").endswith("b"), "gone").otherwise(F.col("h.sha")).alias("sha"))
    return t.commits_since(c, heads)


def _history_over_renames(s: SparkSession, d: str) -> DataFrame:
    """Churn, dates and fixes of each path with what was done under its former names."""
    touched = t.follow_renames(t.touches(table(s, d, "commit_files"), tidy(F.col("new_path"))), _renames(s, d))
    return t.node_history(touched, table(s, d, "commits")).select("node", "churn", "first_changed", "last_changed", "fix_touches")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of source files, measured: the hits of a line are its length modulo three."""
    src = table(s, d, "sources").where("path IS NOT NULL AND text IS NOT NULL").select("path", "text").distinct()
    return src.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line_text")).where("length(line_text) > 0").select("path", (F.col("n") + 1).alias("line"), (F.length("line_text") % 3).alias("hits"), "line_text")


def _symbol_points(s: SparkSession, d: str) -> DataFrame:
    return r.spans(nodes(s, d)).select(F.col("symbol").alias("inner_id"), "path", F.col("a").alias("line"))


def _enclosing(s: SparkSession, d: str) -> DataFrame:
    sp = r.spans(nodes(s, d)).where("b > a")
    j = r.enclosing(_symbol_points(s, d).select("path", "line").distinct(), sp, ["path", "line"])
    return j.select("path", "line", "symbol")


def _overlap(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    of = lambda tag: r.spans(n.where(F.array_contains("tags", tag)))
    other = of("method").select("path", F.col("symbol").alias("method"), F.col("a").alias("c"), F.col("b").alias("d"))
    return r.overlapping(of("class"), other).select(F.col("symbol").alias("class_id"), F.col("method").alias("method_id"))


def _cases(s: SparkSession, d: str) -> DataFrame:
    """Test cases as a runner reports them, one for each Python symbol of a test file, without the file."""
    n = nodes(s, d).where("type = 'symbol' AND path LIKE '%.py' AND name IS NOT NULL").where(r.is_test_path(F.col("path")))
    module = F.translate(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    own = F.regexp_extract("id", r"::([A-Z][A-Za-z0-9_]*)\.", 1)
    return n.select(F.lit(None).cast("string").alias("file"), F.when(own != "", F.concat(module, F.lit("."), own)).otherwise(module).alias("classname"), "name", F.when(F.length("name") % 3 == 0, "failed").otherwise("passed").alias("status"), F.length("name").alias("pos"), F.col("id").alias("case_id"))


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """Lines of code run by tests: the first lines of what symbols of test files call."""
    n = nodes(s, d).where("type = 'symbol' AND path IS NOT NULL AND span_start IS NOT NULL")
    callers = n.select(F.col("id").alias("source"), F.col("path").alias("from_path"))
    called = n.select(F.col("id").alias("target"), "path", F.col("span_start").alias("line"))
    e = edges(s, d).where("type = 'calls' OR type = 'tested_by'").join(callers, "source").where(r.is_test_path(F.col("from_path"))).join(called, "target")
    return e.select("path", "line", F.regexp_replace("source", r"(::\w+)\.", "$1::").alias("context"))


def _imported(s: SparkSession, d: str) -> DataFrame:
    """Lines of files that a test file imports, as run by the first symbol of that test file."""
    n = nodes(s, d).where("type = 'symbol' AND path IS NOT NULL AND span_start IS NOT NULL")
    first = n.groupBy(F.col("path").alias("target")).agg(F.min("id").alias("test"))
    by = r.tested_by_import(edges(s, d), _files(s, d)).select(F.col("source").alias("path"), "target").join(first, "target")
    return by.join(n.select("path", F.col("span_start").alias("line")), "path").select("path", "line", F.regexp_replace("test", r"(::\w+)\.", "$1::").alias("context"))


def _diagnostics(s: SparkSession, d: str) -> DataFrame:
    rows = _lines(s, d).where("line_text LIKE '%return%'").select("path", "line", (F.length("line_text") % 5).alias("severity"), F.trim("line_text").alias("message"))
    out = r.diagnostics(rows, r.spans(nodes(s, d)))
    return out.select("symbol", F.size("diagnostics").cast("bigint").alias("n"), F.size(F.filter("diagnostics", lambda x: x["severity"] == "error")).cast("bigint").alias("n_errors"), F.get("diagnostics", F.lit(0))["severity"].alias("first_severity"))


def _facts(s: SparkSession, d: str) -> DataFrame:
    cov = r.coverage(_lines(s, d), r.spans(nodes(s, d))).select("id", "covered")
    return merge_columns(cov, r.test_statuses(_cases(s, d), nodes(s, d)), "id").select("id", "covered", "status")


def _last_state(s: SparkSession, d: str) -> DataFrame:
    """For each status row of a run, the last run of its project that succeeded before."""
    w = W.partitionBy("project").orderBy("logged_at", "run_id", "status").rowsBetween(W.unboundedPreceding, -1)
    log = table(s, d, "index_runs").select("run_id", "project", "status", "logged_at").distinct()
    return log.withColumn("last_success", F.last(F.when(F.col("status") == "success", F.col("run_id")), ignorenulls=True).over(w))


TOUCHED = r"""
touched AS (SELECT DISTINCT sha, regexp_replace(regexp_replace(replace(new_path, '\', '/'), '/+', '/', 'g'), '^\./', '') AS node FROM commit_files WHERE sha IS NOT NULL AND new_path IS NOT NULL),
c AS (SELECT sha, min(date) AS date, min(author) AS author, min(subject) AS subject FROM commits WHERE sha IS NOT NULL GROUP BY sha),
churn AS (SELECT node, count(*) AS churn FROM touched GROUP BY node)
"""
_PAIRS = """, small AS (SELECT sha FROM touched GROUP BY sha HAVING count(*) BETWEEN 2 AND {0}),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS together FROM touched a JOIN touched b ON a.sha = b.sha AND a.node < b.node WHERE a.sha IN (SELECT sha FROM small) GROUP BY ALL)
"""
_HIST = """, hist AS (SELECT node, count(*) AS churn, min(date) AS first_changed, max(date) AS last_changed, sum(CASE WHEN regexp_matches(coalesce(subject, ''), '(?i)\\b(fix(es|ed)?|bug(fix)?|hotfix|patch|revert)\\b') THEN 1 ELSE 0 END)::BIGINT AS fix_touches FROM touched LEFT JOIN c USING (sha) GROUP BY node),
auth AS (SELECT node, author, count(*) AS n FROM touched JOIN c USING (sha) WHERE author IS NOT NULL GROUP BY ALL)
"""
_TOP = ", top3 AS (SELECT * FROM (SELECT node, sha, date, subject, row_number() OVER (PARTITION BY node ORDER BY date DESC NULLS LAST, sha DESC) AS rank FROM touched JOIN c USING (sha)) WHERE rank <= 3)\n"
IS_TEST = r"""(starts_with(regexp_replace(split_part(lower({0}), '/', -1), '\.[^.]*$', ''), 'test_') OR ends_with(regexp_replace(split_part(lower({0}), '/', -1), '\.[^.]*$', ''), '_test') OR regexp_replace(split_part(lower({0}), '/', -1), '\.[^.]*$', '') IN ('test', 'tests')
OR regexp_matches(lower({0}), '\.(spec\.(js|ts|tsx|py)|test\.(js|ts|tsx))$') OR regexp_matches(lower({0}), '(^|/)(tests|test|__tests__|spec|specs)/'))"""
_SPANS = ", spans AS (SELECT id AS symbol, path, tags, span_start AS a, coalesce(span_end, span_start) AS b FROM n WHERE type = 'symbol' AND path IS NOT NULL AND span_start > 0)\n"
_LINES = ", lines AS (SELECT path, k AS line, (length(line_text) % 3)::INT AS hits, line_text FROM (SELECT path, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS k FROM (SELECT DISTINCT path, text FROM sources WHERE path IS NOT NULL AND text IS NOT NULL)) WHERE length(line_text) > 0)\n"
_COV = """, one AS (SELECT path, line, max(hits) AS hits FROM lines GROUP BY ALL), m AS (SELECT path AS id, hits FROM one UNION ALL SELECT symbol, hits FROM one JOIN spans USING (path) WHERE line BETWEEN a AND b),
cov AS (SELECT id, max((hits > 0)::INT) AS covered, sum((hits > 0)::INT) / count(*) AS ratio FROM m GROUP BY id)
"""
_TB = ", f AS (SELECT id FROM n WHERE type = 'file'), tb AS (SELECT DISTINCT target AS source, source AS target FROM e WHERE type = 'imports' AND source <> target AND " + IS_TEST.format("source") + " AND source IN (SELECT id FROM f) AND target IN (SELECT id FROM f))\n"
_CASES = ", st AS (SELECT id, CASE WHEN length(name) % 3 = 0 THEN 'failed' ELSE 'passed' END AS status FROM n WHERE type = 'symbol' AND path LIKE '%.py' AND name IS NOT NULL AND " + IS_TEST.format("path") + " AND path IN (SELECT id FROM n WHERE type = 'file'))\n"

_RENAMES = r"""WITH RECURSIVE st AS (SELECT o AS old_path, max(w) AS now FROM (SELECT regexp_replace(regexp_replace(replace(old_path, '\', '/'), '/+', '/', 'g'), '^\./', '') AS o, regexp_replace(regexp_replace(replace(new_path, '\', '/'), '/+', '/', 'g'), '^\./', '') AS w FROM commit_files) WHERE o <> w GROUP BY o),
walk AS (SELECT old_path, now, 1 AS k FROM st UNION ALL SELECT walk.old_path, st.now, k + 1 FROM walk JOIN st ON walk.now = st.old_path WHERE k < 50 AND st.now <> walk.old_path),
ends AS (SELECT old_path, arg_max(now, k) AS now FROM walk GROUP BY old_path)
"""

QUERIES = {
    "cochange_file": _cochange,
    "cochange_symbol_cross": lambda s, d: t.co_change_across(_author_days(s, d), _related(s, d), near=(2, 0.05), far=(3, 0.02)),
    "node_history": _node_history,
    "top_commits": lambda s, d: t.top_commits(_touched(s, d), table(s, d, "commits")),
    "authors_cap": lambda s, d: t.top_authors(_touched(s, d), table(s, d, "commits")),
    "hotspots": lambda s, d: t.hotspots(_files(s, d), _history(s, d), _covered(s, d)),
    "working_set_recent": lambda s, d: t.working_set(_history(s, d), _dirty(s, d)),
    "freshness_behind": _behind,
    "age_days": _ages,
    "cochange_theme": _themes,
    "rename_chain": _renames,
    "history_over_renames": _history_over_renames,
    "commits_since": _commits_since,
    "enclosing_span": _enclosing,
    "interval_overlap": _overlap,
    "coverage_ratio": lambda s, d: r.coverage(_lines(s, d), r.spans(nodes(s, d))),
    "junit_priority_match": lambda s, d: r.test_statuses(_cases(s, d), nodes(s, d)),
    "tested_by": lambda s, d: r.tested_by_import(edges(s, d), _files(s, d)),
    "tested_by_context": lambda s, d: r.tested_by_context(_imported(s, d), nodes(s, d)).select("source", "target", "confidence"),
    "diagnostics_by_symbol": _diagnostics,
    "partial_upsert": _facts,
    "asof_last_state": _last_state,
}

ORACLE = {
    "cochange_file": NOW + "," + TOUCHED + _PAIRS.format(25) + f""", w AS (SELECT a, b, together, least(1.0, together / least(x.churn, y.churn)) AS confidence FROM pairs JOIN churn x ON x.node = a JOIN churn y ON y.node = b
WHERE together >= 2 AND a IN (SELECT id FROM n WHERE type = 'file') AND b IN (SELECT id FROM n WHERE type = 'file')),
both_ways AS (SELECT a AS source, b AS target, * EXCLUDE (a, b) FROM w UNION ALL SELECT b, a, * EXCLUDE (a, b) FROM w)
SELECT *, {LABEL} AS label FROM (SELECT source, target, 'co_changes_with' AS type, confidence, together, 'git-cochange' AS provenance FROM both_ways WHERE confidence >= 0.2495)""",
    "cochange_symbol_cross": NOW + "," + TOUCHED.replace("touched AS", "t0 AS").replace("FROM touched", "FROM t0") + """, days AS (SELECT DISTINCT sha, author, date FROM commits WHERE sha IS NOT NULL AND author IS NOT NULL AND date IS NOT NULL),
touched AS (SELECT DISTINCT author || '@' || date::VARCHAR AS sha, array_to_string(string_split(node, '/')[1:2], '/') AS node FROM t0 JOIN days USING (sha)),
ch AS (SELECT node, count(*) AS churn FROM touched GROUP BY node)""" + _PAIRS.format(20) + """, rel AS (SELECT DISTINCT least(split_part(source, '/', 1), split_part(target, '/', 1)) AS pa, greatest(split_part(source, '/', 1), split_part(target, '/', 1)) AS pb FROM e
WHERE contains(source, '/') AND contains(target, '/') AND type IN ('co_changes_with', 'references', 'imports', 'calls')),
w AS (SELECT a, b, together, least(1.0, together / least(x.churn, y.churn)) AS confidence, split_part(a, '/', 1) AS p, split_part(b, '/', 1) AS q FROM pairs JOIN ch x ON x.node = a JOIN ch y ON y.node = b)
SELECT a, b, together, confidence, CASE WHEN p <> q THEN 'git-cochange-sym-xproj' ELSE 'git-cochange-sym' END AS provenance FROM w
WHERE (p = q AND together >= 2 AND confidence >= 0.05) OR (p <> q AND together >= 3 AND confidence >= 0.02 AND EXISTS (SELECT 1 FROM rel WHERE pa = least(p, q) AND pb = greatest(p, q)))""",
    "node_history": "WITH" + TOUCHED + _HIST + "SELECT hist.*, a.authors FROM hist LEFT JOIN (SELECT node, string_agg(author || ':' || n, ',' ORDER BY author) AS authors FROM auth GROUP BY node) a USING (node)",
    "top_commits": "WITH" + TOUCHED + _TOP + "SELECT node, rank::INT AS rank, sha, date, subject FROM top3",
    "authors_cap": "WITH" + TOUCHED + _HIST + "SELECT node, author, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, author) AS k FROM auth) WHERE k <= 5",
    "hotspots": NOW + "," + TOUCHED + _HIST + _TB + """, has AS (SELECT DISTINCT array_to_string(string_split(id, '/')[1:2], '/') AS pkg FROM f WHERE """ + IS_TEST.format("id") + """),
cv AS (SELECT id, CASE WHEN id IN (SELECT source FROM tb) THEN 1 WHEN array_to_string(string_split(id, '/')[1:2], '/') IN (SELECT pkg FROM has) THEN 0 END AS covered FROM f),
x AS (SELECT id, churn, fix_touches, covered, churn + 2 * fix_touches + CASE WHEN covered = 0 THEN 3 ELSE 0 END AS risk FROM cv JOIN hist ON node = id WHERE churn >= 2 OR fix_touches > 0)
SELECT * FROM x WHERE risk >= 4""",
    "working_set_recent": "WITH" + TOUCHED + _HIST + ", dirty AS (SELECT path FROM (SELECT path, content_hash, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) AS k FROM files) WHERE k = 1 AND content_hash IS NULL) SELECT node, last_changed FROM hist WHERE last_changed IS NOT NULL AND node NOT IN (SELECT path FROM dirty) ORDER BY last_changed DESC, node LIMIT 20",
    "freshness_behind": "WITH" + TOUCHED + ", ix AS (SELECT project, max(indexed_at)::DATE - 100 AS indexed_on FROM files WHERE project IS NOT NULL GROUP BY project) SELECT node, count(DISTINCT sha) AS behind FROM touched JOIN c USING (sha) JOIN ix ON ix.project = split_part(node, '/', 1) WHERE date > indexed_on GROUP BY node",
    "age_days": "WITH" + TOUCHED + _HIST + "SELECT node, greatest(0, date_diff('day', first_changed, (SELECT max(date) FROM commits)))::INT AS age_days FROM hist WHERE first_changed IS NOT NULL",
    "cochange_theme": "WITH" + TOUCHED + _PAIRS.format(25) + _TOP + f""", sh AS (SELECT a, b, x.sha, x.date, x.subject, row_number() OVER (PARTITION BY a, b ORDER BY x.date DESC NULLS LAST, x.sha DESC) AS r FROM pairs JOIN top3 x ON x.node = a JOIN top3 y ON y.node = b AND y.sha = x.sha WHERE together >= 2 AND x.subject IS NOT NULL),
ws AS (SELECT a, b, r, unnest(regexp_extract_all(lower(subject), '[a-záéíóúñ]{{3,}}')) AS w, unnest(range(len(regexp_extract_all(lower(subject), '[a-záéíóúñ]{{3,}}')))) AS k FROM sh),
best AS (SELECT a, b, w, count(*) AS n, min(r * 10000 + k) AS met FROM ws WHERE w NOT IN {t.THEME_STOP} GROUP BY ALL), th AS (SELECT a, b, w AS theme FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, met) AS k FROM best) WHERE k = 1)
SELECT sh.a, sh.b, subject, theme FROM sh LEFT JOIN th USING (a, b) WHERE r = 1""",
    "rename_chain": _RENAMES + "SELECT old_path, now FROM ends",
    "history_over_renames": _RENAMES + r""", touched AS (SELECT DISTINCT sha, coalesce(now, path) AS node FROM (SELECT sha, regexp_replace(regexp_replace(replace(new_path, '\', '/'), '/+', '/', 'g'), '^\./', '') AS path FROM commit_files WHERE sha IS NOT NULL AND new_path IS NOT NULL) LEFT JOIN ends ON old_path = path),
c AS (SELECT sha, min(date) AS date, min(subject) AS subject FROM commits WHERE sha IS NOT NULL GROUP BY sha)
SELECT node, count(*) AS churn, min(date) AS first_changed, max(date) AS last_changed, sum(CASE WHEN regexp_matches(subject, '(?i)\b(fix(es|ed)?|bug(fix)?|hotfix|patch|revert)\b') THEN 1 ELSE 0 END)::BIGINT AS fix_touches FROM touched LEFT JOIN c USING (sha) GROUP BY node""",
    "commits_since": """WITH c AS (SELECT project, sha, max(seq) AS seq FROM commits WHERE project IS NOT NULL AND sha IS NOT NULL GROUP BY ALL),
h AS (SELECT project, CASE WHEN project LIKE '%b' THEN 'gone' ELSE max(struct_pack(s := seq, h := sha)).h END AS sha FROM commits WHERE date < DATE '2025-04-01' AND sha IS NOT NULL GROUP BY project),
k AS (SELECT project, max(seq) AS at FROM c JOIN h USING (project, sha) GROUP BY project)
SELECT c.project, c.sha, c.seq, k.project IS NULL AS rebuilt FROM c LEFT JOIN k ON c.project = k.project WHERE k.project IS NULL OR c.seq > k.at""",
    "enclosing_span": NOW + _SPANS + ", p AS (SELECT DISTINCT path, a AS line FROM spans), j AS (SELECT p.path, p.line, symbol, row_number() OVER (PARTITION BY p.path, p.line ORDER BY b - a, symbol) AS k FROM p JOIN spans s ON p.path = s.path AND p.line BETWEEN a AND b AND b > a) SELECT path, line, symbol FROM j WHERE k = 1",
    "interval_overlap": NOW + _SPANS + "SELECT x.symbol AS class_id, y.symbol AS method_id FROM spans x JOIN spans y ON x.path = y.path AND x.a <= y.b AND x.b >= y.a WHERE list_contains(x.tags, 'class') AND list_contains(y.tags, 'method')",
    "coverage_ratio": NOW + _SPANS + _LINES + _COV + "SELECT * FROM cov",
    "junit_priority_match": NOW + _CASES + "SELECT * FROM st",
    "tested_by": NOW + _TB + "SELECT source, target, 'tested_by' AS type, 0.7::DOUBLE AS confidence, 'test-import' AS provenance FROM tb",
    "tested_by_context": NOW + _TB + _SPANS + """, first AS (SELECT path AS target, min(id) AS test FROM n WHERE type = 'symbol' AND path IS NOT NULL AND span_start IS NOT NULL GROUP BY path),
pts AS (SELECT DISTINCT s.path, s.a AS line, test FROM tb JOIN first USING (target) JOIN spans s ON s.path = tb.source WHERE NOT """ + IS_TEST.format("s.path") + """),
j AS (SELECT pts.path, line, test, symbol, row_number() OVER (PARTITION BY pts.path, line, test ORDER BY b - a, symbol) AS k FROM pts JOIN spans s ON s.path = pts.path AND line BETWEEN a AND b)
SELECT DISTINCT symbol AS source, test AS target, 0.95::DOUBLE AS confidence FROM j WHERE k = 1 AND symbol <> test""",
    "diagnostics_by_symbol": NOW + _SPANS + _LINES + """, dg AS (SELECT DISTINCT path, line, coalesce(['error', 'warning', 'info', 'hint'][length(line_text) % 5], 'info') AS sev, trim(line_text) AS msg FROM lines WHERE line_text LIKE '%return%'),
j AS (SELECT symbol, line, sev, msg FROM dg JOIN spans USING (path) WHERE line BETWEEN a AND b)
SELECT symbol, count(*) AS n, count(*) FILTER (sev = 'error') AS n_errors, arg_min(sev, struct_pack(l := sev <> 'error', n := line, m := msg, s := sev)) AS first_severity FROM j GROUP BY symbol""",
    "partial_upsert": NOW + _SPANS + _LINES + _COV + _CASES + "SELECT id, covered, status FROM cov FULL JOIN st USING (id)",
    "asof_last_state": "WITH l AS (SELECT DISTINCT run_id, project, status, logged_at FROM index_runs) SELECT *, last_value(CASE WHEN status = 'success' THEN run_id END IGNORE NULLS) OVER (PARTITION BY project ORDER BY logged_at, run_id, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_success FROM l",
}
