"""How distinctive a term is for a record: log-odds with an informative Dirichlet prior, as z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.session import cut


def terms(text: Column, min_length: int = 3) -> Column:
    """The terms of a text: pieces between characters that are neither letter nor digit, split where a lower-case
    letter or digit meets an upper-case letter, lower-cased; shorter pieces and pieces of digits only are dropped."""
    spaced = F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " ")
    pieces = F.split(spaced, r"[^\p{L}\p{Nd}]+")
    return F.filter(F.transform(pieces, F.lower), lambda t: (F.length(t) >= min_length) & ~t.rlike(r"^\p{Nd}+$"))


def latest(rows: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """The row of each key with the greatest ``at`` (null is earliest), with its ``fields``; ties by the fields."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *fields)).alias("__last"))
    return last.select(key, *(F.col(f"__last.{f}").alias(f) for f in fields))


def log_odds(records: DataFrame, key: str, fields: list[str], prior: float = 1000.0, min_tf: int = 1, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(key, term, tf, df, z): how characteristic each term is of its record against all other records.

    z is the log-odds ratio of the term in the record and in the rest, smoothed by a Dirichlet prior of ``prior``
    pseudo-counts spread as the collection's own counts, divided by its standard error. ``records`` has one row a
    key. Counts are taken over all records; ``min_tf``, ``min_df`` and ``max_df`` only choose which scores are
    returned, before the join, so that frequent terms need not be scored where they are not wanted.

    Null and empty fields count as no text; a record without terms gives no rows; equal records score alike. A
    collection of a single record has no rest, and its z-scores are near zero; where one term is all there is, its
    odds have no bound and z is NaN, as in SQL. Null keys are left out. Terms that a third of the records hold are
    counted by partial aggregates; the join on the term has one row a term on one side, so that adaptive execution may
    split the other. Texts are read once: the counts of terms by record go to the shared folder. Extra columns are
    ignored."""
    text = F.concat_ws(" ", *fields)
    each = records.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), terms(text).alias("__terms")).where(F.size("__terms") > 0)
    tf = cut(each.select("__key", F.size("__terms").cast("bigint").alias("n_key"), F.explode("__terms").alias("term")).groupBy("__key", "n_key", "term").agg(F.count("*").alias("tf")))
    stats = tf.groupBy(F.col("term").alias("__term")).agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("double").alias("n")).scalar()
    stats = stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df if max_df is not None else F.lit(True)))
    both = tf.where(F.col("tf") >= min_tf).join(stats, F.col("term") == F.col("__term")).withColumn("n_all", total)
    y, n, alpha = F.col("tf"), F.col("n_key"), F.col("cf") * (prior / F.col("n_all"))
    rest, n_rest = F.col("cf") - y, F.col("n_all") - n
    delta = F.log((y + alpha) / (n + prior - y - alpha)) - F.log((rest + alpha) / (n_rest + prior - rest - alpha))
    z = delta / F.sqrt(1 / (y + alpha) + 1 / (rest + alpha))
    only = F.col("cf") == F.col("n_all")
    return both.select(F.col("__key").alias(key), "term", "tf", "df", F.when(only, F.lit(float("nan"))).otherwise(z).alias("z"))
