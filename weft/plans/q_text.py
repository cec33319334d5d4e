"""Queries over texts: retrieval, documents, glossaries, endpoints and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.functions import scalar as f
from weft.operators import domain as dm, logs, retrieval as rt, text as tx
from weft.plans.q_graph import NOW, edges, nodes
from weft.session import shared_folder, table

#: What the search queries look for.
QUERY, LEXICAL = "parse registry token for the order queue", "pars qu"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text IS NOT NULL")


def _terms(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return tx.term_counts(n.select("id", tx.node_text(n).alias("text")), "id", "text")


def _count(df: DataFrame):
    return df.agg(F.count("*").alias("n")).scalar()


def _idf(s: SparkSession, d: str) -> DataFrame:
    return tx.idf(_terms(s, d), "id", _count(nodes(s, d))).select("token", "df", F.round("idf", 6).alias("idf"))


def _cosine(s: SparkSession, d: str) -> DataFrame:
    q = tx.term_counts(s.createDataFrame([(0, QUERY)], "q int, text string"), "q", "text")
    return tx.rank_by_query(_terms(s, d), _count(nodes(s, d)), "id", q).select("id", F.round("score", 6).alias("score"))


def _stored_search(s: SparkSession, d: str) -> DataFrame:
    """The same ranking from an index that is stored first and refreshed once."""
    folder = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    rt.refresh_index(nodes(s, d).where("type <> 'file'"), folder + "/1")
    return rt.search_index(s, rt.refresh_index(nodes(s, d), folder + "/2", folder + "/1"), QUERY).select("id", F.round("score", 6).alias("score"))


def _dense(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all vectors."""
    v = table(s, d, "embeddings")
    return tx.rank_dense(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), 10)


def _lexical_ranked(s: SparkSession, d: str) -> DataFrame:
    return tx.ranked(tx.lexical(nodes(s, d), LEXICAL), "hits", 30)


def _substring_ranked(s: SparkSession, d: str) -> DataFrame:
    return tx.ranked(tx.substring_search(nodes(s, d), "parse").withColumn("one", F.lit(1)), "one", 30)


def _rrf(s: SparkSession, d: str) -> DataFrame:
    return tx.fuse(_lexical_ranked(s, d), _substring_ranked(s, d)).select("id", F.round("score", 9).alias("score"))


def _rerank(s: SparkSession, d: str) -> DataFrame:
    churn = table(s, d, "git_node").where("node_id IS NOT NULL").groupBy(F.col("node_id").alias("id")).agg(F.max("churn").alias("churn"))
    return tx.rerank(_substring_ranked(s, d), nodes(s, d), churn, "parse queue").select("id", F.round("score", 6).alias("score"))


def _budget(s: SparkSession, d: str) -> DataFrame:
    lines = dm.document_lines(_docs(s, d), "doc_id", "text").select("doc_id", "n", F.length("line").alias("width"), "line")
    return tx.within_budget(lines, ["doc_id"], "n", "line", 200).select("doc_id", "n", "width")


def _endpoints(s: SparkSession, d: str) -> DataFrame:
    return dm.endpoints(_docs(s, d).where("source IS NOT NULL"), "doc_id", "source", "text", "`(?:GET|POST|PUT|DELETE|PATCH|HEAD) ([^`\\s]+)`")


def _headings(s: SparkSession, d: str) -> DataFrame:
    return dm.decisions(_docs(s, d), "doc_id", "text", heading="(?i)context|decision|consequences|usage|adr-")


def _conventions_documents(s: SparkSession, d: str) -> DataFrame:
    """Rule lines of every Markdown document, whatever its kind; documents without a path count as such."""
    docs = _docs(s, d).where(F.col("path").isNull() | F.lower("path").rlike(r"\.(md|markdown)$"))
    return dm.conventions(docs, "doc_id", "text").select("doc_id", "n", "convention")


def _governs(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return dm.governs(n.where("type IN ('decision', 'convention', 'doc')").select("id", F.concat_ws(" ", "name", "summary", "path").alias("text")), "id", "text", n.where("type IN ('file', 'doc') AND path IS NOT NULL").select(F.col("path").alias("id")).distinct()).select("source", "target")


def _governs_documents(s: SparkSession, d: str) -> DataFrame:
    """The files that whole texts of documents mention."""
    return dm.governs_documents(_docs(s, d), "doc_id", "text", nodes(s, d).where("type = 'file'")).select("source", "target")


def _models(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    glossary = n.where("type = 'entity' AND name IS NOT NULL").select(F.substring_index("id", ":", -1).alias("entity"), F.array("name", F.lower(F.regexp_extract("name", "^[A-Z]?[a-z]+", 0))).alias("aliases"))
    return dm.entity_models(glossary, n).select("source", "target")


def _hash(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", f.content_hash(F.col("text")).alias("hash"), f.token_estimate(F.coalesce("text", F.lit(""))).cast("bigint").alias("tokens"))


def _locations(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", f.location(F.col("path"), F.col("span_start")).alias("location"), f.role(F.col("path")).alias("role"))


_TEXT = "(concat_ws(' ', nullif(name, ''), nullif(name, ''), nullif(type, ''), nullif(signature, ''), nullif(summary, ''), nullif(array_to_string(tags, ' '), ''), nullif(path, '')))"
_STOPS = str(tx.STOP)
_TOKENS = f""", raws AS (SELECT id, unnest(list_filter(regexp_split_to_array({{0}}, '[^A-Za-z0-9]+'), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(regexp_split_to_array({{0}}, '[^A-Za-z0-9]+'), lambda x: x <> ''), 1) AS pos FROM {{1}}),
parts AS (SELECT id, pos, unnest(string_split(lower(regexp_replace(regexp_replace(raw, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' ')) AS token FROM raws),
rows AS (SELECT id, token, 0 AS w, pos FROM parts WHERE length(token) >= 2 UNION ALL SELECT id, lower(raw), 1, pos FROM raws WHERE length(raw) >= 3),
tf AS (SELECT id, token, (sum(1 - w) + CASE WHEN min(pos) FILTER (w = 1) < coalesce(min(pos) FILTER (w = 0), 1000000000) THEN 1 ELSE 0 END)::BIGINT AS tf FROM rows WHERE token NOT IN {_STOPS} AND NOT regexp_full_match(token, '[0-9]+') GROUP BY ALL)
"""
_IDF = ", df AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf WHERE tf > 0 GROUP BY token)\n"


def _cosine_sql(query: str) -> str:
    of_query = _TOKENS.format(f"'{query}'", "(SELECT 0 AS id)")
    for name in ("raws", "parts", "rows", "tf"):
        of_query = of_query.replace(f"{name} AS (", f"q{name} AS (").replace(f"FROM {name}", f"FROM q{name}")
    return NOW + _TOKENS.format(_TEXT, "n") + _IDF + of_query + """, v AS (SELECT id, token, tf * idf AS w FROM tf JOIN df USING (token) WHERE tf > 0), vn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY id),
qv AS (SELECT token, qtf.tf * coalesce(idf, ln((SELECT count(*) FROM n) + 1) + 1) AS w FROM qtf LEFT JOIN df USING (token) WHERE qtf.tf > 0),
cosine AS (SELECT v.id, sum(v.w * qv.w) / any_value(norm) / (SELECT sqrt(sum(w * w)) FROM qv) AS score FROM v JOIN qv USING (token) JOIN vn ON vn.id = v.id GROUP BY v.id)
"""


_LEX = r""", t AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, summary, path, array_to_string(tags, ' '))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM n),
h AS (SELECT id, len(list_filter(t, lambda x: starts_with(x, 'pars'))) AS a, len(list_filter(t, lambda x: starts_with(x, 'qu'))) AS b FROM t), hit AS (SELECT id, (a + b)::BIGINT AS hits FROM h WHERE a > 0 AND b > 0),
l AS (SELECT id, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM hit QUALIFY rank <= 30),
sub AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM n WHERE contains(lower(coalesce(name, '')), 'parse') OR contains(lower(coalesce(summary, '')), 'parse') OR contains(lower(coalesce(path, '')), 'parse') QUALIFY rank <= 30)
"""
_DOC_LINES = "lines AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS n FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS b FROM documents WHERE text IS NOT NULL{0}))"
_EP = r"""WITH raw AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '`(?:GET|POST|PUT|DELETE|PATCH|HEAD) ([^`\s]+)`', 1)) AS raw FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, ':[A-Za-z_]\w*', ':p', 'g'), '\$\{[^}]+\}', ':p', 'g'), '\{[^}]+\}', ':p', 'g'), '/+$', '') AS p FROM raw),
ep AS (SELECT DISTINCT doc_id, source, '/' || array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') AS endpoint FROM c WHERE len(list_filter(string_split(p, '/'), lambda x: x <> '')) >= 2 AND NOT regexp_matches(p, '\.(css|js|png|svg|ico|map|jpg|woff2?)$')),
shared AS (SELECT endpoint FROM ep GROUP BY 1 HAVING count(DISTINCT source) >= 2)
"""
_ROLE = "CASE WHEN path IS NULL OR path = '' THEN 'component' " + " ".join(f"WHEN contains(lower(path), '/{w}/') OR ends_with(lower(path), '/{w}') OR contains(split_part(lower(path), '/', -1), '{w}') THEN '{r}'" for w, r in f.ROLES) + " ELSE 'source file' END"



def _conventions_sql(which: str) -> str:
    return "WITH " + _DOC_LINES.format(which) + rf""", s AS (SELECT doc_id, n, trim(line) AS s FROM lines), x AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(s, '^([-*+]|[0-9]+\.)\s+', ''), '[`*_]', '', 'g')) AS c FROM s WHERE length(s) >= 15 AND NOT starts_with(s, '#') AND regexp_matches(s, '{dm.RULE.replace("'", "''")}')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x WHERE length(c) >= 15) SELECT doc_id, n::INT AS n, left(c, 200) AS convention FROM r WHERE k <= 40"""


QUERIES = {
    "tokenize_terms": _terms,
    "tfidf_idf": _idf,
    "tfidf_cosine": _cosine,
    "stored_search": _stored_search,
    "semantic_rank_dense": _dense,
    "lexical_prefix_and": lambda s, d: tx.lexical(nodes(s, d), LEXICAL),
    "hybrid_rrf": _rrf,
    "hybrid_search": lambda s, d: tx.hybrid(nodes(s, d), LEXICAL).select("id", F.round("score", 9).alias("score")),
    "rerank_deterministic": _rerank,
    "budget_truncate": _budget,
    "domain_candidates": lambda s, d: tx.domain_candidates(nodes(s, d)),
    "endpoint_crosslink": lambda s, d: dm.endpoint_links(_endpoints(s, d), "doc_id", "source").select("source", "target"),
    "endpoint_projects": lambda s, d: dm.project_links(_endpoints(s, d), "source"),
    "headings_sections": lambda s, d: _headings(s, d).select("doc_id", "n", "heading", "slug"),
    "conventions_relate": lambda s, d: dm.relates_to(dm.conventions(_docs(s, d), "doc_id", "text"), "doc_id", "convention", F.col("n")),
    "conventions_firstn": lambda s, d: dm.conventions(_docs(s, d), "doc_id", "text").select("doc_id", "n", "convention"),
    "conventions_documents": _conventions_documents,
    "governs_substring": _governs,
    "governs_documents": _governs_documents,
    "entity_models_cap": _models,
    "summaries": lambda s, d: dm.summaries(nodes(s, d), edges(s, d)),
    "content_hash": _hash,
    "locations_roles": _locations,
    "log_digest": lambda s, d: logs.findings(_docs(s, d), "doc_id", "text"),
    "log_levels": lambda s, d: logs.level_report(_docs(s, d), "doc_id", "text"),
}

ORACLE = {
    "tokenize_terms": NOW + _TOKENS.format(_TEXT, "n") + "SELECT * FROM tf WHERE tf > 0",
    "tfidf_idf": NOW + _TOKENS.format(_TEXT, "n") + _IDF + "SELECT token, df, round(idf, 6) AS idf FROM df",
    "stored_search": _cosine_sql(QUERY) + "SELECT id, round(score, 6) AS score FROM cosine",
    "tfidf_cosine": _cosine_sql(QUERY) + "SELECT id, round(score, 6) AS score FROM cosine",
    "semantic_rank_dense": """WITH x AS (SELECT q.vec_id AS query, r.vec_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0)
SELECT query, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM x) WHERE rank <= 10""",
    "lexical_prefix_and": NOW + _LEX + "SELECT * FROM hit",
    "hybrid_rrf": NOW + _LEX + "SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM sub) GROUP BY id",
    "hybrid_search": _cosine_sql(LEXICAL) + _LEX + """, sem AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM cosine QUALIFY rank <= 45)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM sem UNION ALL SELECT * FROM l) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + rank)) DESC, id LIMIT 15""",
    "rerank_deterministic": NOW + _LEX + """, hay AS (SELECT sub.*, lower(concat_ws(' ', coalesce(name, ''), coalesce(summary, ''), coalesce(path, ''))) AS hay, churn FROM sub JOIN n USING (id) LEFT JOIN (SELECT node_id, max(churn) AS churn FROM git_node GROUP BY 1) ON node_id = id),
k AS (SELECT *, (length(hay) - length(replace(hay, 'parse', ''))) / 5 AS a, (length(hay) - length(replace(hay, 'queue', ''))) / 5 AS b FROM hay)
SELECT id, round(0.5::DOUBLE / rank + least(0.3::DOUBLE, 0.03::DOUBLE * coalesce(churn, 0)) + 3.0::DOUBLE * ((a > 0)::INT + (b > 0)::INT) + 0.2::DOUBLE * (a + b), 6) AS score FROM k""",
    "budget_truncate": "WITH " + _DOC_LINES.format("") + ", r AS (SELECT *, sum(greatest(1, length(line) // 4) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS c FROM lines) SELECT doc_id, n::INT AS n, length(line)::INT AS width FROM r WHERE c <= 200",
    "domain_candidates": NOW + f""", s AS (SELECT id, split_part(name, '.', -1) AS short FROM n WHERE type = 'symbol' AND name IS NOT NULL AND (list_has_any(tags, {list(tx.CLASS_TAGS)}) OR (regexp_matches(split_part(name, '.', -1), '^[A-Z]') AND NOT contains(name, '.')))),
t AS (SELECT DISTINCT id, short, lower(unnest(string_split(regexp_replace(regexp_replace(regexp_replace(short, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), ' '))) AS token FROM s),
u AS (SELECT * FROM t WHERE length(token) >= 3 AND token NOT IN {tx.GENERIC} AND NOT regexp_full_match(token, '[0-9]+'))
SELECT token, count(*) AS n, array_to_string(list_sort(list(DISTINCT short))[1:3], ', ') AS examples FROM u GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 12""",
    "endpoint_crosslink": _EP + "SELECT doc_id::VARCHAR AS source, 'endpoint:' || endpoint AS target FROM ep WHERE endpoint IN (SELECT endpoint FROM shared)",
    "endpoint_projects": _EP + ", p AS (SELECT DISTINCT source, endpoint FROM ep) SELECT a.source AS project_a, b.source AS project_b, count(*) AS shared FROM p a JOIN p b ON a.endpoint = b.endpoint AND a.source < b.source GROUP BY ALL",
    "headings_sections": "WITH " + _DOC_LINES.format("") + r""", h AS (SELECT doc_id, n, regexp_replace(trim(regexp_extract(line, '^(#{1,4})\s+(.*)', 2)), '\s*#*\s*$', '') AS heading FROM lines WHERE regexp_matches(line, '^#{1,4}\s')),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM h WHERE regexp_matches(heading, '(?i)context|decision|consequences|usage|adr-'))
SELECT doc_id, n::INT AS n, heading, coalesce(nullif(left(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50), ''), 'sec') AS slug FROM x WHERE k <= 25""",
    "conventions_firstn": "WITH " + _DOC_LINES.format("") + rf""", s AS (SELECT doc_id, n, trim(line) AS s FROM lines), x AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(s, '^([-*+]|[0-9]+\.)\s+', ''), '[`*_]', '', 'g')) AS c FROM s WHERE length(s) >= 15 AND NOT starts_with(s, '#') AND regexp_matches(s, '{dm.RULE.replace("'", "''")}')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x WHERE length(c) >= 15) SELECT doc_id, n::INT AS n, left(c, 200) AS convention FROM r WHERE k <= 40""",
    "conventions_relate": "WITH " + _DOC_LINES.format("") + rf""", s AS (SELECT doc_id, n, trim(line) AS s FROM lines), x AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(s, '^([-*+]|[0-9]+\.)\s+', ''), '[`*_]', '', 'g')) AS c FROM s WHERE length(s) >= 15 AND NOT starts_with(s, '#') AND regexp_matches(s, '{dm.RULE.replace("'", "''")}')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM x WHERE length(c) >= 15) SELECT DISTINCT 'convention:' || doc_id || ':' || n AS source, 'doc:' || doc_id AS target, 'relates_to' AS type, 0.7::DOUBLE AS confidence FROM r WHERE k <= 40""",
    "conventions_documents": _conventions_sql(r" AND (path IS NULL OR regexp_matches(lower(path), '\.(md|markdown)$'))"),
    "governs_substring": NOW + r""", names AS (SELECT lower(split_part(path, '/', -1)) AS base, min(path) AS target FROM n WHERE type IN ('file', 'doc') AND path IS NOT NULL GROUP BY 1 HAVING length(base) >= 5),
w AS (SELECT DISTINCT id AS source, unnest(regexp_extract_all(lower(concat_ws(' ', name, summary, path)), '[\w\-.]+\.\w+')) AS base FROM n WHERE type IN ('decision', 'convention', 'doc'))
SELECT source, target FROM w JOIN names USING (base)""",
    "governs_documents": NOW + """, names AS (SELECT lower(split_part(path, '/', -1)) AS base, min(path) AS target FROM n WHERE type = 'file' AND path IS NOT NULL GROUP BY 1 HAVING length(base) >= 5)
SELECT doc_id::VARCHAR AS source, target FROM documents JOIN names ON contains(lower(text), base)""",
    "entity_models_cap": NOW + """, g AS (SELECT DISTINCT split_part(id, ':', -1) AS entity, lower(unnest([name, regexp_extract(name, '^[A-Z]?[a-z]+')])) AS alias FROM n WHERE type = 'entity' AND name IS NOT NULL),
x AS (SELECT DISTINCT entity, n.id FROM n JOIN g ON alias <> '' AND (contains(lower(coalesce(name, '')), alias) OR contains(lower(coalesce(split_part(path, '/', -1), '')), alias)) WHERE type IN ('symbol', 'file'))
SELECT 'domain:' || entity AS source, id AS target FROM x QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 60""",
    "content_hash": "SELECT doc_id, left(sha256(text), 16) AS hash, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents",
    "locations_roles": NOW + f"SELECT id, concat_ws(':', path, span_start::VARCHAR) AS location, {_ROLE} AS role FROM n",
    "log_levels": "WITH " + _DOC_LINES.format("") + r", x AS (SELECT doc_id, n, regexp_extract(line, '^\S+ (DEBUG|INFO|WARN|ERROR|FATAL) ', 1) AS level FROM lines) SELECT doc_id, level, count(*) AS n, min(n)::INT AS first_line FROM x WHERE level <> '' GROUP BY ALL",
}
