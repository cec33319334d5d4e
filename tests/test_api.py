"""The directed questions, and operators around single symbols, on small graphs."""

from datetime import date

from pyspark.sql import functions as F

from weft.api import Graph
from weft.operators import deep, model
from weft.sources import settings


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def small(spark):
    n = [("p/orders.py", "file", "orders.py", "p", "p/orders.py", None, None, "order tracking", None, ["python"], None, None), ("p/orders.py::get_order_tracking", "symbol", "get_order_tracking", "p", "p/orders.py", 3, 9, "", "get_order_tracking(id)", ["func"], None, None),
         ("p/misc.py", "file", "misc.py", "p", "p/misc.py", None, None, None, None, None, None, None), ("decision:d#x", "decision", "Order storage", "p", "d.md", 4, None, "We store each order once.", None, None, None, None), ("convention:d:9", "convention", "Always close", "p", "d.md", 9, None, "Always close", None, None, None, None)]
    e = [("p/orders.py", "p/orders.py::get_order_tracking", "defines", 1.0, "ast"), ("p/misc.py", "p/orders.py", "imports", 1.0, "ast"), ("decision:d#x", "p/orders.py", "governs", 0.6, "markdown"), ("p/misc.py", "p/orders.py", "co_changes_with", 0.3, "git")]
    touched = [("c1", "p/orders.py"), ("c1", "p/misc.py"), ("c2", "p/orders.py"), ("c2", "p/misc.py"), ("c3", "p/orders.py")]
    commits = [("c1", "ann", date(2024, 1, 1), "add"), ("c2", "bob", date(2024, 2, 1), "fix it"), ("c3", "bob", date(2024, 3, 1), "more")]
    return Graph(spark.createDataFrame(n, model.NODES), spark.createDataFrame(e, model.EDGES), spark.createDataFrame(touched, "sha string, node string"), spark.createDataFrame(commits, "sha string, author string, date date, subject string"))


def test_questions(spark):
    g = small(spark)
    assert [r.id for r in g.search("order tracking").collect()][0] in ("p/orders.py", "p/orders.py::get_order_tracking")
    assert "p/orders.py::get_order_tracking" in [r.id for r in g.search("order tracking", types=["symbol"], rerank=True).collect()]
    assert rows(g.decisions(), "id", "governs") == [("convention:d:9", []), ("decision:d#x", ["p/orders.py"])]
    assert rows(g.decisions("storage"), "id") == [("decision:d#x",)]
    assert rows(g.neighbors("p/orders.py"), "direction", "other", "label") == [("in", "decision:d#x", "EXTRACTED"), ("in", "p/misc.py", "AMBIGUOUS"), ("in", "p/misc.py", "EXTRACTED"), ("out", "p/orders.py::get_order_tracking", "EXTRACTED")]
    assert rows(g.impact("p/orders.py"), "id", "reasons", "churn") == [("p/misc.py", ["co_changes_with", "imports"], 2)]
    assert g.get("nothing").count() == 0 and g.get("p/orders.py").first().churn == 3 and g.impact("nothing").count() == 0
    h = {(r.section, r["rank"]): (r["name"], r.n) for r in g.history("p/orders.py").collect()}
    assert h[("author", 1)] == ("bob", 2) and h[("commit", 1)] == ("c3 more", None) and h[("partner", 1)] == ("p/misc.py", 2)
    assert ("files", "p/orders.py", 4) in rows(g.overview(), "section", "name", "value")
    assert [(r.node, r.line) for r in g.digest_log('File "/home/x/p/orders.py", line 5\nValueError: no\n').collect()] == [("p/orders.py", 5)]
    assert rows(g.working_set(spark.createDataFrame([("p/misc.py",)], "node string")), "state", "node") == [("dirty", "p/misc.py"), ("recent", "p/orders.py")]
    assert g.compact(g.nodes.select("id"), "id", ["id"], 12).count() == 3


def test_symbols_in_history(spark):
    spans = spark.createDataFrame([("f", "a.py", 1, 5), ("g", "a.py", 7, 300)], "symbol string, path string, a int, b int")
    lines = spark.createDataFrame([("a.py", 2, "s1"), ("a.py", 3, "s1"), ("a.py", 6, "s2"), ("a.py", 250, "s3")], "path string, line int, sha string")
    assert rows(deep.blame_touches(lines, spans), "sha", "node") == [("s1", "f"), ("s3", "g")]
    hunks = spark.createDataFrame([("s1", "a.py", 4, 8), ("s2", "a.py", 6, 6), ("s3", "b.py", 1, 1)], "sha string, path string, a int, b int")
    old = spark.createDataFrame([(s, "a.py", n, c, d) for s in ("s1", "s2") for n, c, d in (("f", 1, 5), ("g", 7, 300))], "sha string, path string, symbol string, c int, d int")
    assert rows(deep.hunk_touches(hunks, old), "sha", "node") == [("s1", "f"), ("s1", "g")]


def test_deep_partners(spark):
    g = small(spark)
    out = deep.deep_partners(g.touched, g.commits, "p/orders.py", spark.createDataFrame([("p/x",)], "id string"))
    assert rows(out, "other", "together", "subjects", "is_new") == [("p/misc.py", 2, ["fix it", "add"], True)]


def test_around(spark):
    a = spark.createDataFrame([("c", 1), ("a", 2)], "id string, rank int")
    b = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "id string, rank int")
    assert [r.id for r in deep.complete_order(a, b).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    s = deep.savings(spark.createDataFrame([(1000, 100, False), (500, 400, None), (9, 1, True)], "before int, after int, illustrative boolean")).first()
    assert (s.before, s.after, s.percent) == (1500, 500, 66)
    cs = spark.createDataFrame([("a.cs", "csharp", "using System.IO;\nnamespace My.App { }"), ("b.vb", "vb", "Imports Sys.X\nNamespace N"), ("c.py", "python", "using x;")], "path string, lang string, text string")
    assert rows(deep.namespaces(cs), "path", "namespace") == [("a.cs", "My.App"), ("a.cs", "System.IO"), ("b.vb", "N"), ("b.vb", "Sys.X")]
    hover = spark.createDataFrame([("```python\ndef f(x: int) -> str\n```\nDocs",), ("",), (None,)], "h string")
    assert [r[0] for r in hover.select(deep.hover_type(F.col("h"))).collect()] == ["def f(x: int) -> str", None, None]


def test_settings(spark):
    ts = '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/app/*"], "~": ["./src"], "u": ["http://x"]}, /* c */ } , }'
    got = settings.settings(spark, [("p", "tsconfig.json", ts), ("p", "go.mod", "module my/x\n\ngo 1.2\n"), ("p", "composer.json", '{"autoload": {"psr-4": {"App\\\\": "src/"}}}'), ("p", "tsconfig.json", "broken {")])
    assert rows(got, "prefix", "base")[:1] == [("@app/", "src/app")] and ("my/x/", "") in rows(got, "prefix", "base") and ("App\\", "src") in rows(got, "prefix", "base")


def test_freshness(spark):
    from weft.operators import freshness as fr

    commits = spark.createDataFrame([("c1", date(2024, 1, 1)), ("c2", date(2024, 2, 1)), ("c3", date(2024, 2, 2)), ("c3", date(2024, 2, 2))], "sha string, date date")
    touched = spark.createDataFrame([("c1", "p/a"), ("c2", "p/a"), ("c2", "q/b"), ("c3", "p/a")], "sha string, node string")
    indexed = spark.createDataFrame([("r", "p", date(2024, 1, 15), "c1"), ("r", "q", date(2024, 1, 15), "c1"), ("s", "z", date(2024, 1, 1), "gone")], "repository string, project string, indexed_on date, head string")
    dirty = spark.createDataFrame([("p/x",), ("p/x",)], "node string")
    got = {r.repository: (r.head_known, r.behind, r.capped, r.n_files_behind, r.n_dirty) for r in fr.freshness(commits, touched, indexed, dirty).collect()}
    assert got == {"r": (True, 2, False, 2, 1), "s": (False, 0, False, 0, 0)}
    capped = fr.freshness(commits, touched, indexed, dirty, 1).withColumn("b", fr.banner(F.col("head_known"), F.col("behind"), F.col("capped"), F.col("n_dirty")))
    assert {r.repository: r.b for r in capped.collect()} == {"r": "1+ commits behind, 1 files changed", "s": "history was rewritten: index again"}


def test_freshness_counts_up_to_the_default_cap(spark, tmp_path):
    from datetime import datetime

    from weft.plans import q_api

    def report(n):
        d = str(tmp_path / str(n))
        tables = {"files": ([("p-ops", "p-ops/a", datetime(2024, 6, 1), "h")], "project string, path string, indexed_at timestamp, content_hash string"),
                  "commits": ([(f"c{i}", "p-ops", "ann", date(2024, 5, 1), "x") for i in range(n)], "sha string, project string, author string, date date, subject string"),
                  "commit_files": ([(f"c{i}", "M", None, "p-ops/a") for i in range(n)], "sha string, status string, old_path string, new_path string")}
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
        return rows(q_api.QUERIES["freshness_commits"](spark, d), "repository", "behind", "capped")

    assert report(150) == [("ops", 150, False)] and report(2001) == [("ops", 2000, True)]
