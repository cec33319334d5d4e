"""Reading sources, and a refresh from arriving files."""

from datetime import datetime as dt

from weft.operators.incremental import advance
from weft.sources import files as src
from weft.streaming import refresh


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_tree(spark, tmp_path):
    root = tmp_path / "my repo"
    for p, t in (("a.py", "x = 1\n"), ("web/b.ts", "let y"), ("node_modules/c.js", "no"), ("docs/r.md", "# R"), ("notes.txt", "n")):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    found = src.tree(spark, str(root), "proj")
    assert rows(found, "path", "lang", "text") == [("proj/a.py", "python", "x = 1\n"), ("proj/web/b.ts", "typescript", "let y")]
    assert rows(src.markdown(spark, str(root), "proj"), "path") == [("proj/docs/r.md",)]
    ignored = spark.createDataFrame([("proj/a.py",), ("proj/web/b.ts",)], "path string")
    assert rows(src.without_ignored(found, ignored, ("proj/web/",)), "path") == [("proj/web/b.ts",)]


def test_git_text(spark):
    log = spark.createDataFrame([("\x1eabc\x1fann\x1f1700000000\x1ffix it\n3\t1\tsrc/{a => b}/c.py\n-\t-\tbin.dat\n",), ("\x1edef\x1fbob\x1f2024-02-03T10:00:00Z\x1fnew\n",), ("noise",)], "value string")
    commits, files = src.git_log(log)
    assert rows(commits, "sha", "author", "date", "subject")[1][:2] == ("def", "bob") and str(rows(commits, "sha", "date")[0][1]) == "2023-11-14"
    assert rows(files, "sha", "old_path", "new_path") == [("abc", "src/a/c.py", "src/b/c.py"), ("abc", None, "bin.dat")] or rows(files, "new_path") == [("bin.dat",), ("src/b/c.py",)]
    show = spark.createDataFrame([("s1", "+++ b/x.py\n@@ -1 +2,3 @@ f\n+a\n@@ -9,2 +11,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n")], "sha string, text string")
    assert rows(src.hunks(show, "sha", "text"), "path", "a", "b") == [("x.py", 2, 4)]
    sha = "a" * 40
    assert rows(src.blame(spark.createDataFrame([("p", f"{sha} 1 7 1\nauthor x\n\tcode")], "path string, t string"), "path", "t"), "line", "sha") == [(7, sha)]
    st = spark.createDataFrame([(" M a.py",), ("R  old.py -> new.py",), ("?? \"sp ace.py\"",)], "value string")
    assert rows(src.status(st), "state", "path") == [("??", "sp ace.py"), ("M", "a.py"), ("R", "new.py")]


def test_reports(spark):
    cov = '<coverage><packages><package><classes><class filename="m.py"><lines><line number="1" hits="0"/><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    assert rows(src.cobertura(spark.createDataFrame([(cov,)], "text string")), "path", "line", "hits") == [("m.py", 1, 2), ("m.py", 2, 0)]
    junit = '<testsuites><testsuite><testcase classname="t.X" name="a"/><testcase classname="t.X" name="b"><failure message="no">why</failure></testcase><testcase classname="t" name="c" file="t.py"><skipped/></testcase></testsuite></testsuites>'
    got = rows(src.junit(spark.createDataFrame([(junit,)], "text string")), "name", "status", "file")
    assert [g[:2] for g in got] == [("a", "passed"), ("b", "failed"), ("c", "skipped")] and got[2][2] == "t.py"
    ctx = '{"files": {"m.py": {"contexts": {"1": ["", "tests.t.f|run", "tests.t.f|setup"]}}}}'
    assert rows(src.coverage_contexts(spark.createDataFrame([(ctx,)], "text string")), "path", "line", "context") == [("m.py", 1, "tests.t.f")]
    g = '{"entities": {"Order": {"description": "d", "aliases": ["order"]}, "X": {}}}'
    assert rows(src.glossary(spark.createDataFrame([(g,)], "text string")), "entity", "aliases") == [("Order", ["order"]), ("X", [])]


def test_junit_suites_in_suites_and_the_last_child(spark):
    report = '<testsuites><testsuite><testsuite><testsuite><testcase classname="t" name="deep"><skipped/><error/></testcase></testsuite></testsuite><testcase classname="t" name="a"><error/><failure/></testcase></testsuite></testsuites>'
    again = '<testsuite><testcase classname="t" name="a"><system-out>x</system-out></testcase><testcase classname="t" name="b"><failure/><skipped/></testcase></testsuite>'
    got = src.junit(spark.createDataFrame([(report,), (again,), (None,), ("no xml",), ("",)], "text string").coalesce(1)).collect()
    assert [(r.name, r.status) for r in sorted(got, key=lambda r: r.pos)] == [("deep", "error"), ("a", "failed"), ("a", "passed"), ("b", "skipped")]
    assert len({r.pos for r in got}) == 4


def test_refresh_from_arrivals(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "ledger")
    empty = spark.createDataFrame([], "key string, version string")
    state = {"n": 0, "seen": []}

    def ledger():
        return spark.read.parquet(f"{store}/{state['n']}") if state["n"] else empty

    def handle(due, number):
        state["seen"] += [(r.key, r.version) for r in due.collect()]
        advance(ledger(), due).write.mode("overwrite").parquet(f"{store}/{state['n'] + 1}")
        state["n"] += 1

    def arrive(*versions):
        spark.createDataFrame([(p, "proj", h, dt(2025, 1, d)) for p, h, d in versions], refresh.ARRIVALS).write.mode("append").parquet(folder)

    for batch in ([("a", "1", 1), ("b", "1", 1)], [("a", "1", 1), ("b", "2", 2)], [("b", "2", 2)]):
        arrive(*batch)
        q = refresh.refresh(refresh.arrivals(spark, folder), str(tmp_path / "cp"), ledger, handle, interval=None)
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted(state["seen"]) == [("a", "1"), ("b", "1"), ("b", "2")]
