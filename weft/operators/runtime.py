"""What tests and tools observed, tied to symbols by the lines they span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Folders and names of test files, and the severities of diagnostics.
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "specs")
TEST_ENDINGS = (".spec.js", ".spec.ts", ".spec.tsx", ".test.js", ".test.ts", ".test.tsx", ".spec.py")
SEVERITIES = {1: "error", 2: "warning", 3: "info", 4: "hint"}


def is_test_path(path: Column) -> Column:
    """By whole segments and by the name, so that latest.py and /testing/ are no tests."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    folders = F.slice(F.split(low, "/"), F.lit(1), F.size(F.split(low, "/")) - 1)
    ending = F.lit(False)
    for e in TEST_ENDINGS:
        ending |= base.endswith(e)
    return F.coalesce(stem.startswith("test_") | stem.endswith("_test") | stem.isin("test", "tests") | ending | F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))), F.lit(False))


def spans(nodes: DataFrame) -> DataFrame:
    """(symbol, path, a, b): the lines of each symbol; without an end it is its first line."""
    s = nodes.where("type = 'symbol' AND path IS NOT NULL AND span_start > 0")
    return s.select(F.col("id").alias("symbol"), "path", F.col("span_start").alias("a"), F.coalesce("span_end", "span_start").alias("b"))


#: Lines in one bin of the range joins.
BIN = 128


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (path, line, ...) joined with the spans (symbol, path, a, b) around each line.

    Spans are listed under the bins of lines they touch, so that the join is on (path, bin) and a file with a third
    of all lines is spread over its bins."""
    p = points.withColumn("__bin", F.floor(F.col("line") / BIN))
    s = spans.where("a <= b").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("a") / BIN), F.floor(F.col("b") / BIN))))
    return p.join(s, ["path", "__bin"]).where("line BETWEEN a AND b").drop("__bin")


def enclosing(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """``points`` (path, line and ``key``, which is unique) with the smallest span around the line; ties by symbol."""
    j = within(points, spans)
    best = j.groupBy(*key).agg(F.min(F.struct((F.col("b") - F.col("a")).alias("size"), "symbol")).alias("m"))
    return best.select(*key, F.col("m.symbol").alias("symbol"))


def all_enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span around each line."""
    return within(points, spans).drop("a", "b")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two interval tables (path, a, b; right's named path, c, d) of one path that overlap."""
    bins = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / BIN), F.floor(F.col(y) / BIN)))
    both = left.where("a <= b").withColumn("__bin", bins("a", "b")).join(right.where("c <= d").withColumn("__bin", bins("c", "d")), ["path", "__bin"])
    # Each pair is kept in the first bin that both touch.
    return both.where("a <= d AND b >= c").where(F.col("__bin") == F.floor(F.greatest("a", "c") / BIN)).drop("__bin")


def coverage(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, covered, ratio) of files and symbols from (path, line, hits): hit over measured lines, unrounded. What has
    no measured line has no row: it is unknown, not uncovered. Several hits of a line count as the greatest."""
    one = lines.where("path IS NOT NULL AND line IS NOT NULL").groupBy("path", "line").agg(F.max("hits").alias("hits"))
    measure = lambda rows, by: rows.groupBy(F.col(by).alias("id")).agg(F.max((F.col("hits") > 0).cast("int")).alias("covered"), (F.sum((F.col("hits") > 0).cast("int")) / F.count("*")).alias("ratio"))
    return measure(one, "path").unionByName(measure(within(one, spans), "symbol"))


def resolve_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(given, file): a path as a tool wrote it, to a file of the graph: the same, or the file whose id ends with it.
    Of several the shortest, then the least. A leading ``./`` is dropped and backslashes are slashes.

    Whole suffixes are joined, each with the one file that is best for it, so that a name that thousands of files have is one
    row, and a path meets one file a suffix."""
    tidy = F.regexp_replace(F.regexp_replace(F.translate("given", "\\", "/"), "/+", "/"), r"^\./", "")
    best = F.min(F.struct(F.length("file").alias("l"), "file")).alias("m")
    p = paths.select("given").distinct().withColumn("tidy", tidy)
    f = files.select(F.col("id").alias("file")).where("file IS NOT NULL").distinct()
    suffix = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, F.size(F.split(c, "/"))), "/")))
    below = f.select("file", suffix(F.col("file")).alias("tidy")).groupBy("tidy").agg(best)
    ends = p.join(below, "tidy").select("given", "tidy", "m.file")
    above = p.select("given", "tidy", suffix(F.col("tidy")).alias("file")).join(f, "file").select("given", "tidy", "file")
    hit = ends.unionByName(above)
    # A file that is the path itself comes first, though a shorter one may end it.
    return hit.groupBy("given").agg(F.min(F.struct((F.col("file") != F.col("tidy")).alias("n"), F.length("file").alias("l"), "file")).alias("m")).select("given", "m.file")


def test_statuses(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, status): the last status (by ``pos``) of each node that a test case names.

    ``cases`` has file, classname, name, status, pos. A classname that ends in a capital word is module and class.
    Tried in order: the qualified name in the file, the bare name, the file."""
    tail = F.substring_index("classname", ".", -1)
    has_class = F.coalesce(tail.rlike("^[A-Z]"), F.lit(False))
    module = F.when(has_class, F.regexp_replace("classname", r"\.?[^.]*$", "")).otherwise(F.col("classname"))
    c = cases.withColumn("__file", F.coalesce("file", F.when(module != "", F.concat(F.translate(module, ".", "/"), F.lit(".py")))))
    c = c.withColumn("__id", F.monotonically_increasing_id()) if "case_id" not in cases.columns else c.withColumn("__id", F.col("case_id"))
    f = nodes.where("type = 'file'").select("id")
    found = resolve_paths(c.select(F.col("__file").alias("given")).where("given IS NOT NULL"), f)
    c = c.join(found, c["__file"] == found["given"])
    qual = F.when(has_class, F.concat(tail, F.lit("."), F.col("name"))).otherwise(F.col("name"))
    tries = F.array(F.struct(F.lit(0).alias("p"), F.concat("file_", F.lit("::"), qual).alias("cand")), F.struct(F.lit(1).alias("p"), F.concat("file_", F.lit("::"), "name").alias("cand")), F.struct(F.lit(2).alias("p"), F.col("file_").alias("cand")))
    c = c.withColumn("file_", found["file"]).select("__id", "status", "pos", F.explode(tries).alias("t")).select("__id", "status", "pos", "t.p", "t.cand")
    hit = c.join(nodes.select(F.col("id").alias("cand")), "cand", "left_semi").groupBy("__id").agg(F.min(F.struct("p", "cand")).alias("m"), F.max("status").alias("status"), F.max("pos").alias("pos"))
    return hit.groupBy(F.col("m.cand").alias("id")).agg(F.max(F.struct("pos", "status")).alias("s")).select("id", "s.status")


def tested_by_import(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from a file to the test file that imports it: deduced, 0.7."""
    ids = files.select("id")
    e = edges.where("type = 'imports' AND source <> target").where(is_test_path(F.col("source")))
    e = e.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("tested_by").alias("type"), F.lit(0.7).alias("confidence"), F.lit("test-import").alias("provenance")).distinct()


def context_tests(contexts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(context, test): the node of each coverage context, ``file::Class::name`` or dotted (the longest module that is a
    file wins); the symbol, its bare name, or the file."""
    ctx = contexts.select("context").distinct().where("trim(context) <> ''").withColumn("c", F.regexp_replace(F.trim("context"), r"\|.*$", ""))
    given = F.substring_index("c", "::", 1)
    direct = ctx.where("contains(c, '::')").select("context", given.alias("given"), F.regexp_replace(F.expr("substring(c, length(substring_index(c, '::', 1)) + 3)"), "::", ".").alias("qual"), F.lit(0).alias("drop"))
    seg = F.split("c", r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(seg) - 1), lambda k: F.struct(F.concat(F.array_join(F.slice(seg, F.lit(1), k), "/"), F.lit(".py")).alias("given"), F.array_join(F.slice(seg, k + 1, F.size(seg)), ".").alias("qual"), (F.size(seg) - k).alias("drop")))
    dotted = ctx.where("NOT contains(c, '::')").where(F.size(seg) > 1).select("context", F.explode(cuts).alias("x")).select("context", "x.given", "x.qual", "x.drop")
    both = direct.unionByName(dotted)
    found = resolve_paths(both.select("given"), nodes.where("type = 'file'").select("id"))
    both = both.join(found, "given").groupBy("context").agg(F.min(F.struct("drop", "file", "qual")).alias("m")).select("context", "m.file", "m.qual")
    tries = F.array(*(F.struct(F.lit(k).alias("p"), e.alias("cand")) for k, e in enumerate((F.concat("file", F.lit("::"), "qual"), F.concat("file", F.lit("::"), F.substring_index("qual", ".", -1)), F.col("file")))))
    c = both.select("context", F.explode(tries).alias("t")).select("context", "t.p", "t.cand").join(nodes.select(F.col("id").alias("cand")), "cand", "left_semi")
    return c.groupBy("context").agg(F.min(F.struct("p", "cand")).alias("m")).select("context", F.col("m.cand").alias("test"))


def tested_by_context(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the symbol around a line to the test that ran it (``lines``: path, line, context): observed, 0.95.
    Only code that is no test is a source."""
    code = lines.where(~is_test_path(F.col("path"))).select("path", "line").distinct()
    around = enclosing(code, spans(nodes), ["path", "line"])
    tests = context_tests(lines, nodes)
    out = lines.join(around, ["path", "line"]).join(tests, "context").where("symbol <> test")
    return out.select(F.col("symbol").alias("source"), F.col("test").alias("target"), F.lit("tested_by").alias("type"), F.lit(0.95).alias("confidence"), F.lit("coverage-context").alias("provenance")).distinct()


def diagnostics(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(symbol, diagnostics): every diagnostic (path, line, severity number, message) in every symbol around its line,
    errors first, then by line and message."""
    sev = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in SEVERITIES.items()), F.lit("info"))
    j = all_enclosing(rows.withColumn("severity", sev), spans)
    item = F.struct((F.col("severity") != "error").alias("later"), "line", "message", "severity")
    return j.groupBy("symbol").agg(F.sort_array(F.collect_set(item)).alias("d")).select("symbol", F.transform("d", lambda x: F.struct(x["severity"].alias("severity"), x["message"].alias("message"), x["line"].alias("line"))).alias("diagnostics"))
