"""A stored index of node texts: postings in buckets of terms, refreshed by content, searched by the terms of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.operators.text import node_text, term_counts
from weft.session import cut

#: Folders that the postings are dealt out over by their term; a query reads those of its own terms.
BUCKETS = 32


def _bucket() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")


def refresh_index(nodes: DataFrame, folder: str, old: str | None = None) -> str:
    """Write the index of ``nodes`` to ``folder`` (a new one) and return it; ``old`` is the folder of the index before.

    Only nodes whose text is new or changed against ``old`` are taken apart; the terms of the others are taken over, those of
    nodes that are gone are left behind. Document frequencies and lengths are counted anew from the postings. A refresh
    that fails leaves the old index as it is. Null ids are left out; of several rows of an id one is taken."""
    texts = nodes.where("id IS NOT NULL").select("id", node_text(nodes).alias("text")).groupBy("id").agg(F.max("text").alias("text"))
    texts = cut(texts.withColumn("version", F.xxhash64("text")))
    spark = nodes.sparkSession
    if old is None:
        fresh, kept = texts, None
    else:
        had = spark.read.parquet(f"{old}/documents").select("id", "version")
        fresh = texts.join(had, ["id", "version"], "left_anti")
        kept = spark.read.parquet(f"{old}/postings").select("id", "version", "token", "tf").join(texts.select("id", "version"), ["id", "version"], "left_semi")
    terms = term_counts(fresh, "id", "text").where("tf > 0").join(fresh.select("id", "version"), "id").select("id", "version", "token", "tf")
    (terms if kept is None else kept.unionByName(terms)).withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    n = texts.agg(F.count("*").alias("n")).scalar()
    postings.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).select("token", "df", "idf", _bucket()).write.parquet(f"{folder}/terms")
    weight = F.col("tf") * F.col("idf")
    norms = postings.join(spark.read.parquet(f"{folder}/terms").select("token", "idf"), "token").groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    texts.select("id", "version").join(norms, "id", "left").write.parquet(f"{folder}/documents")
    return folder


def search_index(spark: SparkSession, folder: str, query: str, limit: int | None = None) -> DataFrame:
    """(id, score): the cosine of each node with the query, above zero, best first with ``limit``.

    Only the folders of the query's own terms are read. A term that no node has counts in the length of the query. A query
    without terms finds nothing."""
    own = term_counts(spark.createDataFrame([(0, query)], "q int, text string"), "q", "text").where("tf > 0").select("token", "tf", _bucket()).collect()
    buckets, tokens = sorted({r.bucket for r in own}), sorted({r.token for r in own})
    documents = spark.read.parquet(f"{folder}/documents")
    n = documents.agg(F.count("*").alias("n")).scalar()
    asked = spark.createDataFrame([(r.token, r.tf) for r in own], "token string, q_tf long")
    idf = spark.read.parquet(f"{folder}/terms").where(F.col("token").isin(tokens)).select("token", "idf")
    q = asked.join(idf, "token", "left").withColumn("w", F.col("q_tf") * F.coalesce("idf", F.log(n + 1) + 1))
    length = q.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l")).scalar()
    met = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)).select("id", "token", "tf")
    hit = met.join(q.where("idf IS NOT NULL").select("token", (F.col("w") * F.col("idf")).alias("w")), "token").groupBy("id").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
    hit = hit.join(documents.select("id", "norm"), "id").select("id", (F.col("dot") / F.col("norm") / length).alias("score")).where("score > 0")
    return hit if limit is None else hit.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
