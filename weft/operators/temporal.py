"""What history says: change coupling, churn, authors, hotspots, working set and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.session import cut

# Thresholds of change coupling. The weights were rounded to three decimals before they were compared, so
# that 0.2495 already passed a threshold of 0.25; the unrounded comparison keeps that.
MIN_TOGETHER, MIN_WEIGHT, MAX_FILES, MAX_SYMBOLS = 2, 0.2495, 25, 20
CROSS_TOGETHER, CROSS_WEIGHT = 3, 0.4995
TOP_COMMITS, TOP_AUTHORS = 3, 5
# How a subject tells a fix, what fragility weighs, and from where it is reported.
FIX_SUBJECT = r"(?i)\b(fix(es|ed)?|bug(fix)?|hotfix|patch|revert)\b"
FIX_WEIGHT, UNCOVERED_WEIGHT, LEAST_RISK = 2, 3, 4
# Words of a commit subject that are no theme.
THEME_STOP = ("the", "and", "for", "with", "fix", "feat", "docs", "chore", "add", "update", "de", "en", "el", "la", "los", "las", "por", "con", "para", "y", "a", "un", "una", "que", "del", "al", "se", "su", "más", "fase", "fases", "wip", "refactor", "refactoriza", "release", "merge", "revert", "initial", "inicial", "bump", "hotfix", "pull", "request", "branch")


def is_fix(subject: Column) -> Column:
    return F.coalesce(subject.rlike(FIX_SUBJECT), F.lit(False))


def as_date(text: Column) -> Column:
    """A date from seconds since the epoch or from an ISO text; null from anything else."""
    return F.when(text.rlike(r"^\d+$"), F.to_date(F.timestamp_seconds(F.try_to_number(text, F.lit("9" * 18))))).otherwise(F.try_to_date(F.substring(text, 1, 10)))


def age_days(first: Column, today: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(today, first))


def expand_rename(path: Column) -> tuple[Column, Column]:
    """The old and the new path of ``a/{x => y}/b`` or ``x => y``; both are the path itself where nothing was renamed."""
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    tidy = lambda c: F.regexp_replace(c, "/+", "/")
    part = lambda k: F.regexp_extract(path, braces, k)
    old = F.when(path.rlike(braces), tidy(F.concat(part(1), part(2), part(4)))).when(path.contains(" => "), F.substring_index(path, " => ", 1)).otherwise(path)
    new = F.when(path.rlike(braces), tidy(F.concat(part(1), part(3), part(4)))).when(path.contains(" => "), F.substring_index(path, " => ", -1)).otherwise(path)
    return old, new


def rename_targets(renames: DataFrame) -> DataFrame:
    """(old_path, now): where a renamed path ended up. ``renames`` has old_path and new_path; of several targets of a
    path the greatest holds. Each round follows twice as far, until every chain has met its end or, in a cycle, has gone as
    far as there are renames."""
    step = renames.where("old_path IS NOT NULL AND new_path IS NOT NULL AND old_path <> new_path").groupBy("old_path").agg(F.max("new_path").alias("now"))
    step = cut(step)
    for _ in range(step.count().bit_length() + 1):
        nxt = step.select(F.col("old_path").alias("now"), F.col("now").alias("__next"))
        joined = step.join(nxt, "now", "left")
        open_ends = joined.where("__next IS NOT NULL AND __next <> old_path").limit(1).count()
        if not open_ends:
            break
        step = cut(joined.select("old_path", F.when(F.col("__next").isNull() | (F.col("__next") == F.col("old_path")), F.col("now")).otherwise(F.col("__next")).alias("now")))
    return step


def touches(commit_files: DataFrame, path: Column) -> DataFrame:
    """(sha, node): each file of a commit once."""
    return commit_files.select("sha", path.alias("node")).where("sha IS NOT NULL AND node IS NOT NULL").distinct()


def commits_since(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(project, sha, seq, rebuilt): the commits that are newer than the last processed one of their project.

    ``heads`` has project and sha. If the sha is no longer among the commits of its project, history was rewritten: all of
    the project's commits come out, with ``rebuilt`` true, and what was counted before must be dropped. So it is for a project
    without a head. Order is that of ``seq``; repeated rows are one, and rows without project or sha are left out."""
    c = commits.where("project IS NOT NULL AND sha IS NOT NULL").groupBy("project", "sha").agg(F.max("seq").alias("seq"))
    h = heads.where("project IS NOT NULL AND sha IS NOT NULL").select("project", "sha").distinct()
    known = c.join(h, ["project", "sha"]).groupBy("project").agg(F.max("seq").alias("__at"), F.lit(True).alias("__known"))
    j = c.join(known, "project", "left")
    return j.where("__known IS NULL OR seq > __at").select("project", "sha", "seq", F.col("__known").isNull().alias("rebuilt"))


def follow_renames(touched: DataFrame, targets: DataFrame) -> DataFrame:
    """(sha, node): what was touched under an old path counts for the path it has now (``targets``: old_path, now), so that
    churn, authors and co-change go on over renames."""
    to = targets.select(F.col("old_path").alias("node"), "now")
    return touched.join(to, "node", "left").select("sha", F.coalesce("now", "node").alias("node")).distinct()


def co_changes(touched: DataFrame, max_nodes: int = MAX_FILES) -> DataFrame:
    """(a, b, together), a < b: commits of two to ``max_nodes`` nodes that touch both. Sizes are counted before any pair
    is formed, and larger commits are looked up and dropped."""
    wide = touched.groupBy("sha").count().where((F.col("count") > max_nodes) | (F.col("count") < 2)).select("sha")
    kept = touched.join(wide, "sha", "left_anti").groupBy("sha").agg(F.sort_array(F.collect_list("node")).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return kept.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("together"))


def churns(touched: DataFrame) -> DataFrame:
    return touched.groupBy("node").agg(F.count("*").alias("churn"))


def co_change_edges(touched: DataFrame, nodes: DataFrame, min_together: int = MIN_TOGETHER, min_weight: float = MIN_WEIGHT, max_nodes: int = MAX_FILES, provenance: str = "git-cochange") -> DataFrame:
    """Edges in both directions between nodes of the graph (``nodes``: id) that change together: together / the lesser
    churn, at most 1, unrounded."""
    pairs = co_changes(touched, max_nodes).where(F.col("together") >= min_together)
    c = churns(touched)
    ids = nodes.select("id").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(ids.select(F.col("id").alias(end)), end, "left_semi").join(c.select(F.col("node").alias(end), F.col("churn").alias(f"churn_{end}")), end)
    w = pairs.withColumn("confidence", F.least(F.lit(1.0), F.col("together") / F.least("churn_a", "churn_b"))).where(F.col("confidence") >= min_weight)
    both = w.select(F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target")))).alias("x"), "confidence", "together")
    return both.select("x.source", "x.target", F.lit("co_changes_with").alias("type"), "confidence", "together", F.lit(provenance).alias("provenance"))


def co_change_across(touched: DataFrame, related: DataFrame, max_nodes: int = MAX_SYMBOLS, near: tuple[int, float] = (MIN_TOGETHER, MIN_WEIGHT), far: tuple[int, float] = (CROSS_TOGETHER, CROSS_WEIGHT), provenance: str = "git-cochange-sym") -> DataFrame:
    """(a, b, together, confidence, provenance): as above, where a pair from two projects (the first segments) needs
    more joint commits, a greater weight and a pair of projects in ``related`` (project_a < project_b)."""
    pairs = co_changes(touched, max_nodes)
    c = churns(touched)
    for end in ("a", "b"):
        pairs = pairs.join(c.select(F.col("node").alias(end), F.col("churn").alias(f"churn_{end}")), end)
    pa, pb = F.substring_index("a", "/", 1), F.substring_index("b", "/", 1)
    pairs = pairs.select("a", "b", "together", F.least(F.lit(1.0), F.col("together") / F.least("churn_a", "churn_b")).alias("confidence"), F.least(pa, pb).alias("project_a"), F.greatest(pa, pb).alias("project_b"))
    ok = related.select("project_a", "project_b", F.lit(True).alias("known")).distinct()
    pairs = pairs.join(ok, ["project_a", "project_b"], "left").withColumn("cross", F.col("project_a") != F.col("project_b"))
    same = ~F.col("cross") & (F.col("together") >= near[0]) & (F.col("confidence") >= near[1])
    other = F.col("cross") & F.col("known").isNotNull() & (F.col("together") >= far[0]) & (F.col("confidence") >= far[1])
    return pairs.where(same | other).select("a", "b", "together", "confidence", F.when(F.col("cross"), provenance + "-xproj").otherwise(provenance).alias("provenance"))


def node_history(touched: DataFrame, commits: DataFrame) -> DataFrame:
    """(node, churn, first_changed, last_changed, fix_touches, authors): one aggregate instead of counters kept up to
    date. Commits that are not known count for churn only."""
    c = commits.where("sha IS NOT NULL").groupBy("sha").agg(F.min("date").alias("date"), F.min("author").alias("author"), F.min("subject").alias("subject"))
    j = touched.join(c, "sha", "left")
    facts = j.groupBy("node").agg(F.count("*").alias("churn"), F.min("date").alias("first_changed"), F.max("date").alias("last_changed"), F.sum(is_fix(F.col("subject")).cast("bigint")).alias("fix_touches"))
    by = j.where("author IS NOT NULL").groupBy("node", "author").agg(F.count("*").alias("n")).groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "n")))).alias("authors"))
    return facts.join(by, "node", "left")


def top_commits(touched: DataFrame, commits: DataFrame, n: int = TOP_COMMITS) -> DataFrame:
    """(node, rank, sha, date, subject): the latest commits of each node, by date and sha."""
    c = commits.where("sha IS NOT NULL").groupBy("sha").agg(F.min("date").alias("date"), F.min("subject").alias("subject"))
    w = W.partitionBy("node").orderBy(F.desc_nulls_last("date"), F.desc("sha"))
    return touched.join(c, "sha").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("node", "rank", "sha", "date", "subject")


def top_authors(touched: DataFrame, commits: DataFrame, n: int = TOP_AUTHORS) -> DataFrame:
    """(node, author, n): the authors with most commits of each node, ties by name."""
    c = commits.where("sha IS NOT NULL AND author IS NOT NULL").groupBy("sha").agg(F.min("author").alias("author"))
    counts = touched.join(c, "sha").groupBy("node", "author").agg(F.count("*").alias("n"))
    return counts.withColumn("__r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "author"))).where(F.col("__r") <= n).drop("__r")


def hotspots(nodes: DataFrame, history: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, churn, fix_touches, covered, risk): nodes that change, are fixed and are not tested. ``covered`` is 1, 0 or
    unknown; unknown is not uncovered."""
    j = nodes.select("id").join(history.select(F.col("node").alias("id"), "churn", F.coalesce("fix_touches", F.lit(0)).alias("fix_touches")), "id").join(covered, "id", "left")
    j = j.where("churn > 0 AND (churn >= 2 OR fix_touches > 0)")
    j = j.withColumn("risk", F.col("churn") + FIX_WEIGHT * F.col("fix_touches") + F.when(F.col("covered") == 0, UNCOVERED_WEIGHT).otherwise(0))
    return j.where(F.col("risk") >= LEAST_RISK).select("id", "churn", "fix_touches", "covered", "risk")


def working_set(history: DataFrame, dirty: DataFrame, limit: int = 20) -> DataFrame:
    """(node, last_changed): what changed last, without what is being changed (``dirty``: node)."""
    recent = history.where("last_changed IS NOT NULL").join(dirty.select("node").distinct(), "node", "left_anti")
    return recent.select("node", "last_changed").orderBy(F.desc("last_changed"), "node").limit(limit)


def commits_behind(commits: DataFrame, touched: DataFrame, indexed: DataFrame) -> DataFrame:
    """(node, behind): commits that touch a file after its project was indexed (``indexed``: project, indexed_on)."""
    c = commits.where("sha IS NOT NULL").groupBy("sha").agg(F.min("date").alias("date"))
    j = touched.join(c, "sha").withColumn("project", F.substring_index("node", "/", 1)).join(indexed, "project").where("date > indexed_on")
    return j.groupBy("node").agg(F.count_distinct("sha").alias("behind"))


def themes(pairs: DataFrame, latest: DataFrame) -> DataFrame:
    """(a, b, subject, theme): for each pair the newest subject among the latest commits that both have, and the word
    that most of these subjects use (ties: the one met first, newest subject first)."""
    x, y = latest.select(F.col("node").alias("a"), "sha", "date", "subject"), latest.select(F.col("node").alias("b"), "sha")
    shared = pairs.select("a", "b").join(x, "a").join(y, ["b", "sha"]).where("subject IS NOT NULL")
    listed = shared.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("date", "sha", "subject")), asc=False).alias("s"))
    words = F.flatten(F.transform("s", lambda r: F.regexp_extract_all(F.lower(r["subject"]), F.lit("[a-záéíóúñ]{3,}"), F.lit(0))))
    words = F.filter(words, lambda w: ~w.isin(*THEME_STOP))
    listed = listed.withColumn("w", words)
    ranked = F.transform(F.array_distinct("w"), lambda w: F.struct(F.size(F.filter("w", lambda v: v == w)).alias("n"), (-F.array_position("w", w)).alias("at"), w.alias("word")))
    return listed.select("a", "b", F.get("s", F.lit(0))["subject"].alias("subject"), F.array_max(ranked)["word"].alias("theme"))
