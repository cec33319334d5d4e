"""The queries of the problems about training data, and the SQL that some of them can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm import chunking, cooccur, distinctive, docpairs, handwritten, leakage, neighbors, packing
from weft.session import table


def _package(path):
    return F.substring_index(path, "/", 2)


def _p2(spark: SparkSession, d: str) -> DataFrame:
    rows = cooccur.baskets(table(spark, d, "commit_files"), F.col("sha"), cooccur.tidy_path(F.col("new_path")), 25)
    return cooccur.co_occurrence(rows, _package(F.col("item")), min_together=4, largest=25)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files of one package that change together at least four times and three times as often as chance."""
    return _p2(spark, d).where("together * n_baskets >= 3 * n_a * n_b").select(F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p2_against_graph(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that change together at least four times, beside what the graph says: the latest co-change confidence
    and the churn of both files."""
    edges = table(spark, d, "edges").where("type = 'co_changes_with' AND source IS NOT NULL AND target IS NOT NULL")
    conf = edges.groupBy("source", "target").agg(F.max(F.struct("observed_at", "confidence")).alias("e")).select(F.col("source").alias("item_a"), F.col("target").alias("item_b"), F.col("e.confidence").alias("edge_confidence"))
    churn = table(spark, d, "git_node").where("node_id IS NOT NULL").groupBy("node_id").agg(F.max("churn").alias("churn"))
    a, b = churn.select(F.col("node_id").alias("item_a"), F.col("churn").alias("churn_a")), churn.select(F.col("node_id").alias("item_b"), F.col("churn").alias("churn_b"))
    out = _p2(spark, d).join(conf, ["item_a", "item_b"], "left").join(a, "item_a", "left").join(b, "item_b", "left")
    return out.select("item_a", "item_b", "together", "n_a", "n_b", "n_baskets", F.round("pmi", 6).alias("pmi"), "edge_confidence", "churn_a", "churn_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths of source files that are generated, minified, copies of third-party code or data."""
    return handwritten.not_handwritten(table(spark, d, "sources")).where("generated OR minified OR vendored OR data").select("path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that a node repeats and that two to eight nodes of the graph use."""
    fields = ["name", "summary", "signature"]
    nodes = distinctive.latest(table(spark, d, "nodes"), "id", "updated_at", fields)
    found = distinctive.log_odds(nodes, "id", fields, min_tf=2, min_df=2, max_df=8)
    return found.where("z IS NOT NULL").select(F.col("id").alias("node_id"), "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of the terms of p4_found."""
    fields = ["name", "summary", "signature"]
    nodes = distinctive.latest(table(spark, d, "nodes"), "id", "updated_at", fields)
    found = distinctive.log_odds(nodes, "id", fields, min_tf=2, min_df=2, max_df=8)
    return found.select(F.col("id").alias("node_id"), "term", "tf", "df", F.round("z", 6).alias("z"))


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """The score of each term of the current row of every node, however rare or frequent it is."""
    fields = ["name", "summary", "signature"]
    nodes = distinctive.latest(table(spark, d, "nodes").fillna("", fields), "id", "updated_at", fields)
    return distinctive.log_odds(nodes, "id", fields).select(F.col("id").alias("node_id"), "term", "tf", "df", F.round("z", 6).alias("z"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes with a cosine of at least 0.9 of which one is among the five most similar of the other."""
    vectors = table(spark, d, "node_vectors").where("embedder = 'dense-64'")
    return neighbors.similar_pairs(neighbors.nearest(vectors, "node_id", "vector", 64)).select("node_a", "node_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods with documentation that says something."""
    return docpairs.function_docs(table(spark, d, "sources")).select("id")


#: Tokens in a container (problem 8) and in a piece (problem 10).
CONTAINER, PIECE, OVERLAP = 2048, 512, 64


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """A container of 2,048 tokens for each text, or for each part of a text that exceeds one."""
    docs = table(spark, d, "documents")
    sizes = packing.token_counts(docs, "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER, docs.count())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 12 consecutive words of an evaluation item, or all the words of a shorter one."""
    index = leakage.build_index(table(spark, d, "documents"), "doc_id", "text")
    return leakage.search(index, table(spark, d, "eval_items"), "item_id", "text").select("item_id", "doc_id")


#: Words around the rarest word of a window in which the others must stand for p9_near.
NEAR = 24


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all words of a window of 12 of an evaluation item near its rarest word, in any order."""
    index = leakage.build_index(table(spark, d, "documents"), "doc_id", "text")
    return leakage.search(index, table(spark, d, "eval_items"), "item_id", "text", near=NEAR).where("kind = 'near'").select("item_id", "doc_id", "n_windows")


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What tells each path of p3_found: headers, names and layout, or the hashes."""
    return handwritten.not_handwritten(table(spark, d, "sources")).where("generated OR minified OR vendored OR data")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each text above 512 tokens."""
    return chunking.split_texts(table(spark, d, "documents"), "doc_id", "text", PIECE, OVERLAP)


_P2_SQL = r"""
WITH rows AS (SELECT DISTINCT sha, regexp_replace(regexp_replace(replace(new_path, '\', '/'), '/+', '/', 'g'), '^\./', '') AS path FROM commit_files WHERE sha IS NOT NULL AND new_path IS NOT NULL),
kept AS (SELECT *, array_to_string(string_split(path, '/')[1:2], '/') AS pkg FROM rows WHERE sha IN (SELECT sha FROM rows GROUP BY sha HAVING count(*) <= 25)),
n AS (SELECT pkg, count(DISTINCT sha) AS n FROM kept GROUP BY pkg),
one AS (SELECT pkg, path, count(*) AS n FROM kept GROUP BY ALL),
two AS (SELECT a.pkg, a.path AS path_a, b.path AS path_b, count(*) AS c FROM kept a JOIN kept b ON a.sha = b.sha AND a.pkg = b.pkg AND a.path < b.path GROUP BY ALL HAVING c >= 4),
pairs AS (SELECT two.*, n.n, x.n AS na, y.n AS nb FROM two JOIN n USING (pkg) JOIN one x ON x.path = path_a JOIN one y ON y.path = path_b)
"""

_P4_SQL = r"""
WITH now AS (SELECT id, max(struct_pack(t := coalesce(updated_at, TIMESTAMP '0001-01-01'), a := coalesce(name, ''), b := coalesce(summary, ''), c := coalesce(signature, ''))) AS r FROM nodes WHERE id IS NOT NULL GROUP BY id),
spaced AS (SELECT id, regexp_replace(concat_ws(' ', r.a, r.b, r.c), '([\p{Ll}\p{Nd}])(\p{Lu})', '\1 \2', 'g') AS text FROM now),
pieces AS (SELECT id, lower(unnest(regexp_split_to_array(text, '[^\p{L}\p{Nd}]+'))) AS term FROM spaced),
tf AS (SELECT id, term, count(*) AS tf FROM pieces WHERE length(term) >= 3 AND NOT regexp_full_match(term, '\p{Nd}+') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
"""

_P6_SQL = """
WITH v AS (SELECT node_id, min(vector::DOUBLE[]) AS v FROM node_vectors WHERE embedder = 'dense-64' AND len(vector) = 64 AND list_sum([abs(x) FOR x IN vector]) > 0 GROUP BY node_id),
sims AS (SELECT a.node_id AS a, b.node_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a JOIN v b ON a.node_id <> b.node_id),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM sims)
SELECT DISTINCT least(a, b) AS node_a, greatest(a, b) AS node_b FROM best WHERE n <= 5 AND s >= 0.9
"""

QUERIES = {"p2_found": p2_found, "p2_against_graph": p2_against_graph, "p3_found": p3_found, "p3_evidence": p3_evidence, "p4_found": p4_found, "p4_scores": p4_scores, "p4_terms": p4_terms, "p6_found": p6_found, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p9_near": p9_near, "p10_pieces": p10_pieces}

ORACLE = {
    "p2_found": _P2_SQL + "SELECT path_a, path_b FROM pairs WHERE c * n >= 3 * na * nb",
    "p2_against_graph": _P2_SQL + """, conf AS (SELECT source, target, max(struct_pack(t := observed_at, c := confidence)).c AS edge_confidence FROM edges WHERE type = 'co_changes_with' GROUP BY ALL),
churn AS (SELECT node_id, max(churn) AS churn FROM git_node GROUP BY node_id)
SELECT path_a AS item_a, path_b AS item_b, c AS together, na AS n_a, nb AS n_b, n AS n_baskets, round(log2(c * n / (na * nb)), 6) AS pmi, edge_confidence, x.churn AS churn_a, y.churn AS churn_b
FROM pairs LEFT JOIN conf ON source = path_a AND target = path_b LEFT JOIN churn x ON x.node_id = path_a LEFT JOIN churn y ON y.node_id = path_b""",
    "p4_found": _P4_SQL + "SELECT id AS node_id, term FROM tf JOIN df USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 8",
    "p4_scores": _P4_SQL + """, c AS (SELECT term, sum(tf)::DOUBLE AS cf FROM tf GROUP BY term), n AS (SELECT id, sum(tf)::DOUBLE AS n FROM tf GROUP BY id), a AS (SELECT sum(tf)::DOUBLE AS total FROM tf),
v AS (SELECT id, term, tf, df, n, total, cf - tf AS rest, cf * 1000 / total AS alpha FROM tf JOIN df USING (term) JOIN c USING (term) JOIN n USING (id), a WHERE tf >= 2 AND df BETWEEN 2 AND 8)
SELECT id AS node_id, term, tf, df, round((ln((tf + alpha) / (n + 1000 - tf - alpha)) - ln((rest + alpha) / (total - n + 1000 - rest - alpha))) / sqrt(1 / (tf + alpha) + 1 / (rest + alpha)), 6) AS z FROM v""",
    "p4_terms": _P4_SQL + """, c AS (SELECT term, sum(tf)::DOUBLE AS cf FROM tf GROUP BY term), n AS (SELECT id, sum(tf)::DOUBLE AS n FROM tf GROUP BY id), a AS (SELECT sum(tf)::DOUBLE AS total FROM tf),
v AS (SELECT id, term, tf, df, n, total, cf - tf AS rest, cf * 1000 / total AS alpha FROM tf JOIN df USING (term) JOIN c USING (term) JOIN n USING (id), a)
SELECT id AS node_id, term, tf, df, round((ln((tf + alpha) / (n + 1000 - tf - alpha)) - ln((rest + alpha) / (total - n + 1000 - rest - alpha))) / sqrt(1 / (tf + alpha) + 1 / (rest + alpha)), 6) AS z FROM v""",
    "p6_found": _P6_SQL,
}
