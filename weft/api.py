"""The directed questions of the graph, each one DataFrame: overview, search, neighbors, get, decisions, stats,
working_set, impact, history and digest_log. A node that does not exist gives no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from weft.operators import graph, logs, model, temporal, text


@dataclass
class Graph:
    """``nodes`` and ``edges`` have one row a key. Of history, ``touched`` is (sha, node) and ``commits`` the commits;
    ``runtime`` has id and what tests observed."""

    nodes: DataFrame
    edges: DataFrame
    touched: DataFrame | None = None
    commits: DataFrame | None = None
    runtime: DataFrame | None = None

    @classmethod
    def of_tables(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame, **more: DataFrame) -> "Graph":
        return cls(model.current_nodes(nodes), model.current_edges(edges), **more)

    def _history(self) -> DataFrame:
        return temporal.node_history(self.touched, self.commits)

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes, self.edges)

    def overview(self, scope: str | None = None) -> DataFrame:
        """(section, rank, name, value): projects, totals, shared endpoints and key files."""
        st = graph.graph_stats(self.nodes, self.edges).where("metric IN ('nodes_by_project', 'nodes', 'edges') AND (metric <> 'nodes_by_project' OR key IS NOT NULL)")
        ranked = lambda df, section, *order: df.withColumn("section", F.lit(section)).withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy(*order))).select("section", "rank", "name", "value")
        totals = ranked(st.select(F.coalesce("key", "metric").alias("name"), F.col("n").alias("value"), "metric"), "totals", F.desc("metric"), "name")
        ends = self.nodes.where("type = 'entity'").where(F.array_contains("tags", "endpoint")).select("name", F.lit(None).cast("bigint").alias("value")).orderBy("name").limit(25)
        files = graph.hubs(self.nodes, self.edges, "file", scope, 30).select(F.col("id").alias("name"), F.col("degree").alias("value"))
        return totals.unionByName(ranked(ends, "endpoints", "name")).unionByName(ranked(files, "files", F.desc("value"), "name"))

    def search(self, query: str, types: list[str] | None = None, limit: int = 15, rerank: bool = False) -> DataFrame:
        """(id, score, type, name, signature, location, summary), best first."""
        found = text.hybrid(self.nodes, query, limit, types)
        if rerank:
            churn = temporal.churns(self.touched).select(F.col("node").alias("id"), "churn") if self.touched is not None else self.nodes.select("id", F.lit(None).cast("bigint").alias("churn")).limit(0)
            found = text.rerank(text.ranked(found, "score", limit), self.nodes, churn, query)
        return found.join(self.nodes, "id").select("id", "score", "type", "name", "signature", F.concat_ws(":", "path", F.col("span_start").cast("string")).alias("location"), "summary").orderBy(F.desc("score"), "id")

    def neighbors(self, node_id: str, edge_types: list[str] | None = None) -> DataFrame:
        return graph.neighbors(self.nodes, self.edges, node_id, edge_types)

    def get(self, node_id: str) -> DataFrame:
        """The node with what history and tests say of it."""
        n = self.nodes.where(F.col("id") == node_id)
        if self.touched is not None and self.commits is not None:
            n = n.join(temporal.node_history(self.touched.where(F.col("node") == node_id), self.commits).withColumnRenamed("node", "id"), "id", "left")
        return n.join(self.runtime, "id", "left") if self.runtime is not None else n

    def decisions(self, topic: str | None = None) -> DataFrame:
        """(id, type, name, summary, location, governs): decisions and conventions, all or those that a search finds, with
        up to five paths that each governs."""
        n = self.nodes.where("type IN ('decision', 'convention')")
        if topic:
            n = n.join(text.hybrid(self.nodes, topic, 20, ["decision", "convention"]).select("id"), "id", "left_semi")
        paths = self.nodes.where("path IS NOT NULL").select(F.col("id").alias("target"), F.col("path").alias("governed"))
        g = self.edges.where("type = 'governs'").join(paths, "target").select(F.col("source").alias("id"), "governed").distinct()
        g = g.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("governed"))).where("k <= 5").groupBy("id").agg(F.array_sort(F.collect_list("governed")).alias("governs"))
        return n.join(g, "id", "left").select("id", "type", "name", "summary", F.concat_ws(":", "path", F.col("span_start").cast("string")).alias("location"), F.coalesce("governs", F.array().cast("array<string>")).alias("governs"))

    def working_set(self, dirty: DataFrame, limit: int = 20) -> DataFrame:
        """(state, node, last_changed): what is being changed, then what changed last."""
        d = dirty.select("node").distinct().select(F.lit("dirty").alias("state"), "node", F.lit(None).cast("date").alias("last_changed"))
        return d.unionByName(temporal.working_set(self._history(), dirty, limit).select(F.lit("recent").alias("state"), "node", "last_changed"))

    def impact(self, node_id: str, depth: int = 1) -> DataFrame:
        """(id, depth, reasons, churn, fix_touches): co-change first, then by id."""
        seed = self.nodes.where(F.col("id") == node_id).select("id")
        found = graph.impact(self.edges, seed, depth)
        if self.touched is not None and self.commits is not None:
            found = found.join(self._history().select(F.col("node").alias("id"), "churn", "fix_touches"), "id", "left")
        return found.orderBy(~F.array_contains("reasons", "co_changes_with"), "id")

    def history(self, node_id: str) -> DataFrame:
        """(section, rank, name, n, day): authors by commits, the latest commits, and the five closest partners."""
        own = self.touched.where(F.col("node") == node_id)
        day = F.lit(None).cast("date")
        authors = temporal.top_authors(own, self.commits, 2**31 - 1).select(F.lit("author").alias("section"), F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "author")).alias("rank"), F.col("author").alias("name"), "n", day.alias("day"))
        commits = temporal.top_commits(own, self.commits).select(F.lit("commit").alias("section"), "rank", F.concat_ws(" ", "sha", "subject").alias("name"), F.lit(None).cast("bigint").alias("n"), F.col("date").alias("day"))
        with_it = self.touched.join(own.select("sha"), "sha", "left_semi").where(F.col("node") != node_id).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(5)
        partners = with_it.select(F.lit("partner").alias("section"), F.row_number().over(W.partitionBy().orderBy(F.desc("n"), "node")).alias("rank"), F.col("node").alias("name"), "n", day.alias("day"))
        return authors.unionByName(commits).unionByName(partners)

    def digest_log(self, log: str, limit: int = logs.MAX_FINDINGS) -> DataFrame:
        """(rank, node, path, line, message): the findings of one log, with the file of the graph each is in."""
        from weft.operators.runtime import resolve_paths

        one = self.nodes.sparkSession.createDataFrame([(0, log)], "k int, text string")
        found = logs.findings(one, "k", "text", limit).drop("k")
        files = resolve_paths(found.where("path IS NOT NULL").select(F.col("path").alias("given")), self.nodes.where("type = 'file'").select("id"))
        return found.join(files.select(F.col("given").alias("path"), F.col("file").alias("node")), "path", "left").select("rank", "node", "path", "line", "message").orderBy("rank")

    @staticmethod
    def compact(answer: DataFrame, line: str, order: list[str], budget: int) -> DataFrame:
        """The first lines of an answer within a token budget."""
        numbered = answer.withColumn("__n", F.row_number().over(W.partitionBy().orderBy(*order))).withColumn("__all", F.lit(0))
        return text.within_budget(numbered, ["__all"], "__n", line, budget).drop("__n", "__all")
