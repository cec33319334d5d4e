"""Queries that build the graph from source text, compare snapshots and watch for rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.operators import deep, extract as ex, snapshots as sn
from weft.session import cut, table
from weft.sources.files import language


def _sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sources").where("path IS NOT NULL AND text IS NOT NULL").select("path", "text", language(F.col("path")).alias("lang")).distinct()


def _of(s: SparkSession, d: str, lang: str) -> DataFrame:
    return _sources(s, d).where(F.col("lang") == lang)


def _symbols(s: SparkSession, d: str) -> DataFrame:
    """Every symbol of the languages other than Python, the first of each name in a file, with its span."""
    found = ex.facts(_sources(s, d).where("lang <> 'python'")).where("kind = 'node' AND contains(id, '::')")
    return found.select("id", F.col("line"), "end_line", F.element_at("tags", -1).alias("tag"))


def _top_level(s: SparkSession, d: str) -> DataFrame:
    """Functions and types of Go and Rust files that stand at the beginning of a line, and no method."""
    found = ex.facts(_sources(s, d).where("lang IN ('go', 'rust')")).where("kind = 'node' AND contains(id, '::') AND NOT contains(name, '.')")
    return found.select("path", "name", "line")


def _imports(facts: DataFrame, sources: DataFrame) -> DataFrame:
    named = facts.where("kind = 'import'").select("path", F.col("name").alias("raw")).distinct()
    return ex.resolve_imports(named.join(sources.select("path", "lang").distinct(), "path"), sources.select("path"))


def _import_edges(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    return ex.import_edges(_imports(ex.facts(src).where("kind = 'import' AND (via IS NULL OR via <> 'member')"), src))


def _import_facts(s: SparkSession, d: str) -> DataFrame:
    """Distinct imports of Go, Java and Python files as they are written, without the members that they name."""
    found = ex.facts(_sources(s, d).where("lang IN ('go', 'java', 'python')")).where("kind = 'import' AND (via IS NULL OR via <> 'member')")
    return found.select("path", F.col("name").alias("raw")).distinct()


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Calls inside files, and across files where exactly one symbol is meant, of all languages."""
    src = _sources(s, d)
    facts = cut(ex.facts(src))
    resolved = _imports(facts, src)
    calls = facts.where("kind = 'call'").join(src.select("path", "lang").distinct(), "path")
    bindings, symbols = facts.where("kind = 'binding'"), facts.where("kind = 'node' AND contains(id, '::')").select("id", "path", "name")
    inside = facts.where("kind = 'edge' AND name = 'calls'").select("source", "target", F.lit("calls").alias("type"), "confidence")
    python = lambda df: df.where("lang = 'python'")
    out = inside.unionByName(ex.call_edges(python(calls), bindings, python(resolved), symbols)).unionByName(ex.call_edges_by_import(calls, bindings, resolved, symbols))
    out = out.unionByName(ex.call_edges_by_namespace(calls, deep.namespaces(src), symbols))
    return out.groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"))


def _python_calls(s: SparkSession, d: str) -> DataFrame:
    facts = ex.python(_of(s, d, "python"))
    imports = facts.where("kind = 'import'").select("path", F.lit("python").alias("lang"), F.col("name").alias("raw"))
    resolved = ex.resolve_imports(imports, _sources(s, d).select("path"))
    inside = facts.where("kind = 'edge' AND name = 'calls'").select("source", "target", F.lit("calls").alias("type"), "confidence")
    return inside.unionByName(ex.call_edges(facts.where("kind = 'call'"), facts.where("kind = 'binding'"), resolved, facts.where("kind = 'node' AND contains(id, '::')").select("id", "path", "name")))


def _diff(s: SparkSession, d: str) -> DataFrame:
    """Paths as they were on the first of April 2025 and as they are."""
    f = table(s, d, "files").where("path IS NOT NULL")
    state = lambda rows: rows.groupBy("path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("l")).select("path", F.col("l.content_hash").alias("v"))
    return sn.snapshot_diff(state(f.where("indexed_at < '2025-04-01'")), state(f), "path", "v")


QUERIES = {
    "extract_python": lambda s, d: ex.python(_of(s, d, "python")).where("kind = 'node'").select("id", "name", "line", "end_line", "signature", "summary"),
    "extract_patterns": _symbols,
    "top_level_symbols": _top_level,
    "import_facts": _import_facts,
    "import_edges": _import_edges,
    "python_calls": _python_calls,
    "calls": _calls,
    "snapshot_diff": _diff,
    "debounce_sessions": lambda s, d: sn.debounced(table(s, d, "events"), ["user_id"], "ts", "6 hours"),
}

ORACLE = {
    "top_level_symbols": r"""WITH src AS (SELECT DISTINCT path, replace(text, chr(13), '') AS text, split_part(path, '.', -1) AS ext FROM sources WHERE path IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT path, ext, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM src WHERE ext IN ('go', 'rs')),
words AS (SELECT path, ext, n, list_filter(string_split(replace(replace(replace(replace(l, 'pub(crate)', ''), '(', ' ('), '<', ' <'), '{', ' {'), ' '), lambda x: x NOT IN ('', 'pub', 'async', 'unsafe', 'const')) AS w FROM lines WHERE regexp_matches(l, '^[a-z]'))
SELECT path, regexp_extract(w[2], '^[A-Za-z0-9_]+') AS name, min(n)::INT AS line FROM words
WHERE (ext = 'go' AND w[1] IN ('func', 'type') OR ext = 'rs' AND w[1] IN ('fn', 'struct', 'enum', 'trait', 'union', 'type')) AND regexp_matches(w[2], '^[A-Za-z_]') GROUP BY ALL""",
    "import_facts": r"""WITH src AS (SELECT DISTINCT path, replace(text, chr(13), '') AS text, split_part(path, '.', -1) AS ext FROM sources WHERE path IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT path, ext, trim(unnest(string_split(text, chr(10)))) AS l FROM src WHERE ext IN ('go', 'java', 'py'))
SELECT DISTINCT path, CASE ext WHEN 'go' THEN string_split(l, '"')[2] WHEN 'java' THEN rtrim(replace(replace(l, 'import ', ''), 'static ', ''), ';') ELSE string_split(l, ' ')[2] END AS raw FROM lines
WHERE (ext IN ('go', 'java') AND starts_with(l, 'import ') AND NOT contains(l, '(')) OR (ext = 'py' AND (starts_with(l, 'from ') AND contains(l, ' import ') OR starts_with(l, 'import ')))""",
    "snapshot_diff": """WITH f AS (SELECT path, content_hash AS v, indexed_at FROM files WHERE path IS NOT NULL), b AS (SELECT path, v FROM f WHERE indexed_at < TIMESTAMP '2025-04-01' QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1),
a AS (SELECT path, v FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) = 1), j AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path)
SELECT * FROM j WHERE change IS NOT NULL""",
    "debounce_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM x) SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS n FROM y GROUP BY user_id, g""",
}
