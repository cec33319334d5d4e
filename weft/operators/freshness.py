"""How far an index is behind the repository it was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: commits that are looked at; beyond it a count is a lower bound.
MOST_COMMITS = 2000


def freshness(commits: DataFrame, touched: DataFrame, indexed: DataFrame, dirty: DataFrame, cap: int = MOST_COMMITS) -> DataFrame:
    """(repository, indexed_on, head_known, behind, capped, n_files_behind, n_dirty) for each repository of ``indexed``
    (repository, project, indexed_on, head).

    A commit of a repository counts once, however many of its projects it touches. ``behind`` is counted after the day
    of indexing, up to ``cap``, and ``capped`` tells that there are more. head_known is false where the commit that was
    indexed is no longer in the history: it was rewritten, and what is behind cannot be told. ``dirty`` has node."""
    at = indexed.groupBy("repository").agg(F.min("indexed_on").alias("indexed_on"), F.max("head").alias("head"))
    c = commits.where("sha IS NOT NULL").groupBy("sha").agg(F.min("date").alias("date"))
    heads = at.select("repository", F.col("head").alias("sha")).join(c.select("sha"), "sha", "left_semi").select("repository", F.lit(True).alias("known"))
    home = indexed.select("repository", "project")
    project = F.substring_index("node", "/", 1)
    late = touched.withColumn("project", project).join(home, "project").join(at.select("repository", "indexed_on"), "repository").join(c, "sha").where("date > indexed_on")
    # Both distinct counts from one aggregate on pairs, so that a repository with most commits is combined map-side.
    behind = late.select("repository", "sha").distinct().groupBy("repository").agg(F.count("*").alias("n"))
    files = late.select("repository", "node").distinct().groupBy("repository").agg(F.count("*").alias("n_files_behind"))
    changed = dirty.select("node").distinct().withColumn("project", project).join(home, "project").groupBy("repository").agg(F.count("*").alias("n_dirty"))
    j = at.join(heads, "repository", "left").join(behind, "repository", "left").join(files, "repository", "left").join(changed, "repository", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return j.select("repository", "indexed_on", F.coalesce("known", F.lit(False)).alias("head_known"), F.least(zero("n"), F.lit(cap).cast("bigint")).alias("behind"), (zero("n") > cap).alias("capped"), zero("n_files_behind").alias("n_files_behind"), zero("n_dirty").alias("n_dirty"))


def banner(head_known: Column, behind: Column, capped: Column, n_dirty: Column) -> Column:
    """One line on freshness, or null where there is nothing to say."""
    commits = F.when(behind > 0, F.concat(behind.cast("string"), F.when(capped, "+").otherwise(""), F.lit(" commits behind")))
    files = F.when(n_dirty > 0, F.concat(n_dirty.cast("string"), F.lit(" files changed")))
    said = F.concat_ws(", ", commits, files)
    return F.when(~head_known, "history was rewritten: index again").when(said != "", said)
