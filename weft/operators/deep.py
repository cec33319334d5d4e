"""Symbols in history, fragments of source, and other operators around symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.operators.runtime import overlapping, within
from weft.operators.substrings import count_containing, least_words
from weft.operators.temporal import MAX_SYMBOLS
from weft.session import cut

# Lines of source that are read for a node without an end, and for one without a start.
FRAGMENT, HEAD = 40, 60


def blame_touches(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(sha, node): the commits that last wrote a line of each symbol, from blamed lines (path, line, sha)."""
    return within(lines, spans).select("sha", F.col("symbol").alias("node")).distinct()


def hunk_touches(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(sha, node): the symbols each commit changed, from changed ranges (sha, path, a, b) and the spans that symbols had
    in that commit (sha, path, symbol, c, d). The commit is part of the place, so that histories do not mix."""
    place = F.concat_ws("\x1f", "sha", "path")
    left = hunks.select(place.alias("path"), F.col("sha").alias("__sha"), "a", "b")
    right = spans.select(place.alias("path"), F.col("symbol").alias("node"), "c", "d")
    return overlapping(left, right).select(F.col("__sha").alias("sha"), "node").distinct()


def deep_partners(touched: DataFrame, commits: DataFrame, node: str, known: DataFrame, min_together: int = 2, max_nodes: int = MAX_SYMBOLS) -> DataFrame:
    """(other, together, subjects, is_new): what changed with one symbol in its whole history, in commits of at most
    ``max_nodes`` symbols, with the subjects as evidence; is_new tells those that ``known`` (id) lacks."""
    small = touched.groupBy("sha").count().where(F.col("count").between(2, max_nodes)).select("sha")
    own = touched.where(F.col("node") == node).select("sha").join(small, "sha", "left_semi")
    c = commits.where("sha IS NOT NULL").groupBy("sha").agg(F.max(F.struct("date", "subject")).alias("c"))
    with_it = touched.where(F.col("node") != node).join(own, "sha").join(c, "sha", "left")
    out = with_it.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("together"), F.sort_array(F.collect_list(F.struct("c.date", "sha", "c.subject")), asc=False).alias("s")).where(F.col("together") >= min_together)
    k = known.select(F.col("id").alias("other"), F.lit(False).alias("__new")).distinct()
    return out.join(k, "other", "left").select("other", "together", F.transform("s", lambda x: x["subject"]).alias("subjects"), F.coalesce("__new", F.lit(True)).alias("is_new"))


def fragments(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, fragment): the lines of source of each node; without an end up to 40, without a start the first 60."""
    src = sources.where("path IS NOT NULL AND text IS NOT NULL").groupBy("path").agg(F.max("text").alias("text")).select("path", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n").alias("l"))
    first = F.coalesce("span_start", F.lit(1))
    n = F.when(F.col("span_start").isNull(), HEAD).otherwise(F.coalesce(F.col("span_end") - F.col("span_start") + 1, F.lit(FRAGMENT)))
    j = nodes.where("path IS NOT NULL").select("id", "path", first.alias("a"), n.alias("n")).join(src, "path").where("a >= 1 AND n >= 0")
    return j.select("id", F.array_join(F.slice("l", F.col("a"), F.col("n")), "\n").alias("fragment"))


def alias_matches(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, n): how many symbols and files have a name or path that contains one of an entity's aliases
    (``aliases``: entity, aliases).

    An alias that contains another one of its entity finds nothing more and is left out. Each set of aliases that is
    left is counted once, for all entities that share it."""
    alias = aliases.select("entity", F.explode(F.transform("aliases", F.lower)).alias("alias")).where("alias <> ''")
    own = alias.groupBy("entity").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    own = cut(own.select("entity", least_words(F.col("aliases")).alias("aliases")))
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("path", F.lit(""))))
    hay = nodes.where("type IN ('symbol', 'file') AND id IS NOT NULL").groupBy("id").agg(F.collect_set(text).alias("texts"))
    n = count_containing(hay, "texts", own.select("aliases").distinct(), "aliases")
    return own.join(n, "aliases").select("entity", "n")


def complete_order(ranked: DataFrame, given: DataFrame) -> DataFrame:
    """(id, rank): all of ``given`` (id, rank), those of ``ranked`` (id, rank) first, the rest in the order given."""
    r = ranked.groupBy("id").agg(F.min("rank").alias("__r"))
    j = given.join(r, "id", "left")
    return j.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.asc_nulls_last("__r"), "rank", "id"))).select("id", "rank")


def savings(rows: DataFrame) -> DataFrame:
    """(before, after, percent) over tasks (before, after, illustrative) that are not only illustrative."""
    t = rows.where(~F.coalesce("illustrative", F.lit(False))).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return t.withColumn("percent", F.when(F.col("before") > 0, F.floor(100 * (F.col("before") - F.col("after")) / F.col("before"))))


def namespaces(files: DataFrame) -> DataFrame:
    """(path, namespace, declared): the namespaces that C# and Visual Basic files (path, lang, text) declare or use.

    A line counts by its first word; a C# line that uses one ends with a semicolon and has one more word only."""
    line = F.explode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"))
    words = F.split(F.trim(F.translate("line", "{;", " ;")), r"[\s;]+")
    each = files.where("text IS NOT NULL AND lang IN ('csharp', 'vb')").select("path", "lang", line.alias("line")).select("path", "lang", "line", F.filter(words, lambda w: w != "").alias("w"))
    head = F.when(F.col("lang") == "vb", F.lower(F.get("w", F.lit(0)))).otherwise(F.get("w", F.lit(0)))
    uses = F.when(F.col("lang") == "vb", head == "imports").otherwise((head == "using") & (F.size("w") == 2) & F.trim("line").endswith(";"))
    named = each.select("path", F.get("w", F.lit(1)).alias("namespace"), (head == "namespace").alias("declared"), uses.alias("uses"))
    return named.where("namespace IS NOT NULL AND (declared OR uses)").groupBy("path", "namespace").agg(F.max("declared").alias("declared"))


def hover_type(hover: Column) -> Column:
    """The first line of a hover text that says something: no fences and no language names; at most 200 characters."""
    lines = F.transform(F.split(hover, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^`+|`+$", "")))
    said = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin("python", "typescript", "javascript", "go", "rust", "java", "c", "cpp", "csharp", "php", "ruby", "text", "plaintext"))
    return F.substring(F.get(said, F.lit(0)), 1, 200)
