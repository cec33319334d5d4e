"""Retrieval over nodes: identifier terms, TF-IDF, lexical search, fusion, re-ranking and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.functions.scalar import camel_spaced

# Words that are no terms.
STOP = ("the", "and", "for", "with", "que", "los", "las", "del", "por", "una", "uno", "de", "la", "el", "en", "un", "self", "this", "const", "let", "var", "def", "function", "class", "import", "from", "return", "async", "await", "true", "false", "none", "null", "src")
# The constant of rank fusion and the weights of re-ranking.
RRF_K = 60
HIT, COUNT, ORDER, HEAT, MOST_HEAT = 3.0, 0.2, 0.5, 0.03, 0.3
# Words of class names that are no domain concept, and the tags of what is like a class.
GENERIC = (
    "controller", "service", "model", "manager", "handler", "client", "repository", "factory", "impl", "base", "util", "utils", "helper", "provider", "builder", "adapter", "config", "test", "tests", "main", "app", "api", "dto", "entity", "exception", "error",
    "request", "response", "router", "route", "routes", "middleware", "module", "component", "view", "page", "panel", "modal", "form", "button", "list", "item", "data", "store", "cache", "logger", "log", "scheduler", "executor", "validator", "verifier", "monitor",
    "tracker", "index", "wrapper", "context", "session", "state", "worker",
)
CLASS_TAGS = ("class", "type", "struct", "interface", "trait", "enum", "record")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): identifier terms of a text. A word gives its camel-case parts (two characters or more) each
    time; the whole word (three or more) comes once, and only where no equal term stands before it."""
    raws = F.filter(F.split(F.col(text), "[^A-Za-z0-9]+"), lambda w: w != "")
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(raws).alias("pos", "raw"))
    fine = lambda t, n: (F.length(t) >= n) & ~t.isin(*STOP) & ~t.rlike("^[0-9]+$")
    parts = F.filter(F.split(F.lower(camel_spaced(F.col("raw"))), " "), lambda t: fine(t, 2))
    whole = F.lower(F.col("raw"))
    tokens = F.concat(F.transform(parts, lambda t: F.struct(t.alias("t"), F.lit(0).alias("w"))), F.when(fine(whole, 3), F.array(F.struct(whole.alias("t"), F.lit(1).alias("w")))).otherwise(F.array().cast("array<struct<t:string,w:int>>")))
    rows = each.select(key, "pos", F.explode(tokens).alias("x")).select(key, F.col("x.t").alias("token"), F.col("x.w").alias("w"), "pos")
    n = rows.groupBy(key, "token").agg(F.sum(1 - F.col("w")).alias("parts"), F.min(F.when(F.col("w") == 1, F.col("pos"))).alias("first_whole"), F.min(F.when(F.col("w") == 0, F.col("pos"))).alias("first_part"))
    extra = F.when(F.col("first_whole").isNotNull() & (F.col("first_part").isNull() | (F.col("first_whole") < F.col("first_part"))), 1).otherwise(0)
    return n.select(key, "token", (F.col("parts") + extra).cast("bigint").alias("tf")).where("tf > 0")


def node_text(nodes: DataFrame) -> Column:
    """What a node is searched by: its name twice, type, signature, summary, tags and path."""
    part = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", part(F.col("name")), part(F.col("name")), part(F.col("type")), part(F.col("signature")), part(F.col("summary")), part(F.array_join("tags", " ")), part(F.col("path")))


def idf(tf: DataFrame, key: str, n_docs: Column) -> DataFrame:
    """(token, df, idf): ln((N + 1) / (df + 1)) + 1 over all documents, empty ones included."""
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("n", n_docs).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vectors(tf: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, token, weight): tf * idf over its length, in long form."""
    w = tf.join(weights.select("token", "idf"), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return w.select(key, "token", (F.col("w") / norm).alias("weight"))


def rank_by_query(tf: DataFrame, n_docs: Column, key: str, query: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, score): the cosine of each document with a query (``query``: token, tf), above zero, best first.

    A term that no document has counts in the query's length with the weight of a term of no document. Only the
    terms of the query are looked up among the postings."""
    weights = idf(tf, key, n_docs)
    q = query.join(weights.select("token", "idf"), "token", "left").withColumn("n", n_docs)
    q = q.withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.col("n") + 1) + 1))
    q = q.select("token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy()))).alias("qw"))
    hits = vectors(tf, weights, key).join(q, "token").groupBy(key).agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).where("score > 0")
    return hits if limit is None else hits.orderBy(F.desc(F.round("score", 9)), key).limit(limit)


def rank_dense(rows: DataFrame, key: str, vector: str, queries: DataFrame, limit: int, block: int = 2048) -> DataFrame:
    """(query, key, score, rank): for each vector of ``queries`` (same columns) the ``limit`` rows with the greatest dot
    product, itself included, ties by key; scores are rounded to 6 decimals.

    The queries are a stated set: ``block`` of them at a time go to the workers and meet every row, and each Arrow
    batch gives only its own best rows on. Vectors that are null, have nulls or another size are left out."""
    import numpy as np
    import pyarrow as pa

    first = queries.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    dim = first[0] if first else 0
    fine = lambda df: df.where((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))
    kind = rows.schema[key].dataType.simpleString()

    def job(ids: list, matrix: np.ndarray):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                scores = np.round(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) @ matrix.T, 6)
                for lo in range(0, len(ids), 256):
                    part = scores[:, lo:lo + 256]
                    # Everything that ties with the last of the best is kept, so that the tie is settled by key later.
                    least = -np.sort(-part, axis=0)[min(limit, len(part)) - 1]
                    r, q = np.nonzero(part >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type).take(pa.array(q + lo)), b.column(0).take(pa.array(r)), pa.array(part[r, q])], ["query", key, "score"])
        return run

    found, ids, vectors = None, [], []

    def add():
        part = fine(rows).select(key, vector).mapInArrow(job(list(ids), np.asarray(vectors, np.float64)), f"query {kind}, `{key}` {kind}, score double")
        return part if found is None else found.unionByName(part)

    for r in fine(queries).select(key, vector).toLocalIterator():
        ids.append(r[0]), vectors.append(r[1])
        if len(ids) == block:
            found, ids, vectors = add(), [], []
    if ids or found is None:
        found = add() if ids else rows.sparkSession.createDataFrame([], f"query {kind}, `{key}` {kind}, score double")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", best).where(F.col("rank") <= limit)


def lexical(nodes: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """(id, hits): nodes of which name, summary, path or tags have, for every word of the query, a token that begins
    with it; hits counts such tokens. Types are filtered before anything is matched."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "summary", "path", F.array_join("tags", " "))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    n = nodes.select("id", words.alias("t"))
    hits = F.lit(0)
    ok = F.lit(bool(query.split()))
    for term in query.lower().split():
        begun = F.filter("t", _begins(term))
        ok &= F.size(begun) > 0
        hits = hits + F.size(begun)
    return n.where(ok).select("id", hits.cast("bigint").alias("hits"))


def _begins(term: str):
    return lambda x: x.startswith(term)


def substring_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the query in name, summary or path, whatever its case."""
    q = query.lower()
    hit = F.lit(False)
    for c in ("name", "summary", "path"):
        hit |= F.coalesce(F.lower(c).contains(q), F.lit(False))
    return nodes.where(hit).select("id")


def fuse(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score) of several rankings (id, rank from 1): the sum of 1 / (k + rank)."""
    both = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(rows: DataFrame, score: str, limit: int) -> DataFrame:
    """(id, rank): the best ``limit`` rows by score, ties by id."""
    best = rows.orderBy(F.desc(score), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.desc(score), "id"))).select("id", "rank")


def hybrid(nodes: DataFrame, query: str, limit: int = 15, types: list[str] | None = None) -> DataFrame:
    """(id, score): TF-IDF ranking and lexical search, fused by rank; the best ``limit``."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    docs = nodes.select("id", node_text(nodes).alias("text"))
    tf = term_counts(docs, "id", "text")
    q = term_counts(nodes.sparkSession.createDataFrame([(query,)], "text string").withColumn("q", F.lit(0)), "q", "text")
    semantic = rank_by_query(tf, docs.agg(F.count("*").alias("n")).scalar(), "id", q)
    semantic = ranked(semantic.withColumn("score", F.round("score", 9)), "score", limit * 3)
    return fuse(semantic, ranked(lexical(nodes, query), "hits", limit * 2)).orderBy(F.desc("score"), "id").limit(limit)


def rerank(candidates: DataFrame, nodes: DataFrame, churn: DataFrame, query: str) -> DataFrame:
    """(id, score) of candidates (id, rank from 1): what they contain of the query's words counts most, then the order
    they came in, then how often they change."""
    j = candidates.join(nodes.select("id", F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("path", F.lit("")))).alias("hay")), "id").join(churn.select("id", "churn"), "id", "left")
    score = ORDER / F.col("rank") + F.least(F.lit(MOST_HEAT), HEAT * F.coalesce("churn", F.lit(0)))
    for term in dict.fromkeys(_words(query)):
        n = (F.length("hay") - F.length(F.replace("hay", F.lit(term)))) / len(term)
        times = _words(query).count(term)
        score = score + times * (F.when(n > 0, HIT).otherwise(0.0) + COUNT * n)
    return j.select("id", score.alias("score"))


def _words(query: str) -> list[str]:
    import re

    return [t for t in re.findall(r"\w+", query.lower()) if len(t) > 2]


def within_budget(lines: DataFrame, group: list[str], order: str, text: str, budget: int) -> DataFrame:
    """The first lines of each group whose estimated tokens, with one for each line, sum to at most ``budget``."""
    cost = F.greatest(F.lit(1), F.floor(F.length(text) / 4)) + 1
    return lines.withColumn("__c", F.sum(cost).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("__c") <= budget).drop("__c")


def domain_candidates(nodes: DataFrame, limit: int = 12) -> DataFrame:
    """(token, n, examples): words that at least two class-like symbols use, with three names each; most frequent first,
    ties by word."""
    s = nodes.where("type = 'symbol' AND name IS NOT NULL")
    short = F.substring_index("name", ".", -1)
    like = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, CLASS_TAGS))), F.lit(False)) | (short.rlike("^[A-Z]") & ~F.col("name").contains("."))
    tokens = F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace(camel_spaced(short), "([0-9]+)", " $1 "), "[^A-Za-z0-9]+"), lambda w: w != ""), F.lower))
    t = s.where(like).select("id", short.alias("short"), F.explode(tokens).alias("token")).where((F.length("token") >= 3) & ~F.col("token").isin(*GENERIC) & ~F.col("token").rlike("^[0-9]+$"))
    names = t.groupBy("token", "short").agg(F.count("*").alias("k"))
    first = names.withColumn("r", F.row_number().over(W.partitionBy("token").orderBy("short"))).where("r <= 3").groupBy("token").agg(F.array_join(F.array_sort(F.collect_list("short")), ", ").alias("examples"))
    n = names.groupBy("token").agg(F.sum("k").alias("n")).where("n >= 2").orderBy(F.desc("n"), "token").limit(limit)
    return n.join(first, "token")
