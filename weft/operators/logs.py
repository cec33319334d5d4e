"""Distilling logs of tests and builds to their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.functions.scalar import plain_lines

# Endings of names of errors, of what a condensed line names, and of files that tools report on.
ERRORS = ("Error", "Exception", "Warning")
FAILURES = (*ERRORS, "Failure")
TS_FILES = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
WEB_FILES = (*TS_FILES, "vue", "svelte")
CODE_FILES = (*WEB_FILES, "go", "py")
BULLETS = ("●", "✕", "×")
OUTCOMES = ("failed", "passed", "error", "errors")
#: A log in which none of these words stands, in any case, has no findings: every format needs one.
MARKS = "(?i)error|exception|warning|fail"
MAX_FINDINGS = 8


def _word(n: int) -> Column:
    return F.coalesce(F.get("words", F.lit(n)), F.lit(""))


def _rest(n: int) -> Column:
    """The line from its n-th word on, as it is written."""
    skipped = F.aggregate(F.slice("words", 1, n), F.col("s"), lambda left, w: F.ltrim(F.substring(left, F.length(w) + 1, F.length(left))))
    return F.rtrim(skipped)


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out |= name.endswith(e)
    return out


def _is_file(path: Column, endings: tuple[str, ...] | None = None) -> Column:
    """Whether a path has an ending: one of these, or any that begins with a letter."""
    ending = F.substring_index(path, ".", -1)
    known = ending.isin(*endings) if endings else ending.rlike("^[A-Za-z][A-Za-z0-9_]*$")
    return path.contains(".") & (F.length(path) > F.length(ending) + 1) & known if not endings else path.contains(".") & known


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))


def _is_name(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_.]*$")


def _places(lines: DataFrame) -> DataFrame:
    """The parts of each line that formats look at: its words, what its first word points to, and a quoted frame."""
    lines = lines.withColumn("s", F.trim("line")).withColumn("words", F.split("s", r"\s+"))
    colon = F.split(_word(0), ":")
    inside = F.substring_index(F.substring_index(_word(0), "(", -1), ")", 1)
    quoted, after = F.split(F.substring_index("line", 'File "', -1), '"', 2), F.substring_index("line", '", line ', -1)
    framed = F.col("line").contains('File "') & F.col("line").contains('", line ') & F.get(quoted, F.lit(1)).startswith(", line ")
    last = F.split(F.regexp_replace(F.try_element_at("words", F.lit(-1)), r"[()]", " "), " ")
    at = F.split(F.try_element_at(F.filter(last, lambda w: w != ""), F.lit(-1)), ":")
    return lines.select(
        "*", F.get(colon, F.lit(0)).alias("c_path"), _number(F.get(colon, F.lit(1))).alias("c_line"), (F.size(colon).isin(3, 4) & (F.try_element_at(colon, F.lit(-1)) == "")).alias("c_whole"),
        F.when(_word(0).endswith("):") & _word(0).contains("(") & (F.size(F.split(inside, ",")) == 2), F.substring_index(_word(0), "(", 1)).alias("p_path"), _number(F.substring_index(inside, ",", 1)).alias("p_line"),
        F.when(framed, F.get(quoted, F.lit(0))).alias("f_path"), F.when(framed, _number(F.get(F.split(after, "[^0-9]"), F.lit(0)))).alias("f_line"),
        F.when((_word(0) == "at") & (F.size(at) == 3), F.get(at, F.lit(0))).alias("a_path"), _number(F.get(at, F.lit(1))).alias("a_line"), F.col("line").rlike(r"^\s").alias("indented"))


def _summed() -> Column:
    """What a closing line between signs of equality says, if it counts outcomes."""
    said = F.trim(F.trim(F.col("s"), F.lit("=")))
    words = F.split(said, "[ ,]+")
    counts = F.exists(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b")), lambda p: p["a"].rlike("^[0-9]+$") & p["b"].isin(*OUTCOMES))
    return F.when(F.col("s").startswith("=") & F.col("s").endswith("=") & F.coalesce(counts, F.lit(False)), said)


def log_lines(logs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n from 1, line) without colour codes."""
    body = F.regexp_replace(plain_lines(F.col(text)), "\r\n?", "\n")
    return logs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(body, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def findings(logs: DataFrame, key: str, text: str, limit: int | None = MAX_FINDINGS) -> DataFrame:
    """(key, rank, path, line, message): the distinct findings of each log, those of one-line formats first, then those
    of formats with blocks, each in order of lines, the first ``limit`` of a log.

    What a format remembers from line to line is carried by windows over the lines of a log. Lines that no format
    could need are dropped before the windows. Null texts give nothing; a log of any length is one sort."""
    lines = _places(log_lines(logs.where(F.col(text).rlike(MARKS)), key, text))
    named = F.substring(_word(0), 1, F.length(_word(0)) - 1)
    node = F.split(_word(1), "::")
    failed = _word(0).isin("FAILED", "ERROR") & ~F.get(node, F.lit(0)).contains(":") & (_word(1) != "") & ((F.size("words") == 2) | (_word(2) == "-") & (F.size("words") > 3))
    error = _word(0).endswith(":") & _is_name(named) & _ends(named, ERRORS) & (F.size("words") > 1)
    pointed = F.col("c_whole") & F.col("c_line").isNotNull() & _is_file(F.col("c_path"))
    what = F.regexp_replace(_word(1), "[^A-Za-z0-9_].*$", "")
    kind = (F.when(_summed().isNotNull(), "summary").when(failed, "failed").when(F.col("f_path").isNotNull() & F.col("f_line").isNotNull(), "frame").when(error, "error")
            .when(pointed & (F.try_element_at(F.split(_word(0), ":"), F.lit(-1)) == "") & (F.size(F.split(_word(0), ":")) == 3) & _is_name(what) & _ends(what, FAILURES), "condensed")
            .when(pointed & F.lower(_word(1)).isin("error", "error:") & (F.size("words") > 2), "tool"))
    opens_go = F.col("line").startswith("--- FAIL: ") | F.col("line").startswith("=== FAIL: ")
    empty = F.col("s") == ""
    go = F.when(opens_go, 1).when(~empty & ~F.col("indented"), 0)
    eslint = F.when((F.size("words") == 1) & ~F.col("indented") & _is_file(F.col("s"), WEB_FILES), F.col("s")).when(empty, "")
    opens_jest = (_word(0) == "FAIL") & (_word(1) != "")
    title = F.when(opens_jest, "").when(_word(0).isin(*BULLETS) & (F.size("words") > 1), _rest(1))
    cells = F.split(_word(0), ":")
    lines = lines.withColumns({
        "kind": kind, "go": go, "eslint": eslint, "jest": F.when(opens_jest, _word(1)), "title": title, "message": F.when(kind == "failed", F.when(F.size("words") > 3, _rest(3)).otherwise(_word(0))).when(kind == "error", F.concat(named, F.lit(": "), _rest(1))).when(kind == "condensed", what).when(kind == "tool", F.concat(F.lit("error: "), _rest(2))),
        "is_tsc": F.coalesce(_is_file(F.col("p_path"), TS_FILES) & F.col("p_line").isNotNull() & (_word(1) == "error") & _word(2).startswith("TS") & _word(2).endswith(":") & (F.size("words") > 3), F.lit(False)),
        "is_go": F.coalesce(F.col("indented") & F.col("c_whole") & F.col("c_line").isNotNull() & F.col("c_path").endswith(".go"), F.lit(False)) | F.coalesce(F.col("indented") & (F.size(cells) == 3) & F.col("c_path").endswith(".go") & F.col("c_line").isNotNull(), F.lit(False)),
        "is_eslint": F.col("indented") & (F.size(cells) == 2) & F.col("c_line").isNotNull() & F.get(cells, F.lit(0)).rlike("^[0-9]+$") & _word(1).isin("error", "warning") & (F.size("words") > 2),
        "is_jest": F.coalesce(_is_file(F.col("a_path"), CODE_FILES) & F.col("a_line").isNotNull(), F.lit(False))})
    lines = lines.where("kind IS NOT NULL OR go IS NOT NULL OR eslint IS NOT NULL OR jest IS NOT NULL OR title IS NOT NULL OR is_tsc OR is_go OR is_eslint OR is_jest")
    at = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    carry = lambda c: F.last(c, ignorenulls=True).over(at)
    # A frame counts for the next error only: an error puts an empty frame in its place.
    frame = F.when(F.col("kind") == "frame", F.struct(F.col("f_path").alias("path"), F.col("f_line").alias("line"))).when(F.col("kind") == "error", F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")))
    lines = lines.withColumns({"last_frame": carry(frame), "in_go": carry("go"), "in_eslint": carry("eslint"), "in_jest": carry("jest"), "jest_title": carry("title")})

    def found(order: int, when: Column, path: Column, at_line: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(order).alias("format"), path.alias("path"), at_line.alias("line"), message.alias("message")))

    none = F.lit(None).cast("int")
    linear = F.coalesce(
        found(0, F.col("kind") == "failed", F.get(F.split(_word(1), "::"), F.lit(0)), none, F.col("message")), found(0, F.col("kind") == "error", F.col("last_frame.path"), F.col("last_frame.line"), F.col("message")),
        found(0, F.col("kind").isin("condensed", "tool"), F.col("c_path"), F.col("c_line"), F.col("message")))
    tsc = found(1, F.col("is_tsc"), F.col("p_path"), F.col("p_line"), _rest(1))
    gos = found(2, F.col("is_go") & (F.col("in_go") == 1), F.col("c_path"), F.col("c_line"), F.when(F.size("words") > 1, _rest(1)).otherwise("go test: FAIL"))
    esl = found(3, F.col("is_eslint") & (F.coalesce("in_eslint", F.lit("")) != ""), F.col("in_eslint"), _number(F.get(F.split(_word(0), ":"), F.lit(0))), F.concat(_word(1), F.lit(": "), _rest(2)))
    jst = found(4, F.col("is_jest") & F.col("in_jest").isNotNull(), F.col("a_path"), F.col("a_line"), F.concat(F.lit("jest: "), F.when(F.coalesce("jest_title", F.lit("")) != "", F.col("jest_title")).otherwise("test failed")))
    each = lines.select(key, "n", F.explode(F.filter(F.array(linear, tsc, gos, esl, jst), lambda x: x.isNotNull())).alias("f")).select(key, "n", "f.*")
    once = each.groupBy(key, "path", "line", "message").agg(F.min(F.struct("format", "n")).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("first", "path", "line", "message"))
    out = once.withColumn("rank", rank).select(key, "rank", "path", "line", "message")
    return out if limit is None else out.where(F.col("rank") <= limit)


def outcome(logs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, outcome): the last summary line of a test runner in each log."""
    lines = _places(log_lines(logs, key, text)).withColumn("said", _summed()).where("said IS NOT NULL")
    return lines.groupBy(key).agg(F.max_by("said", "n").alias("outcome"))


def level_report(logs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, n, first_line): lines of application logs by level."""
    lines = log_lines(logs, key, text).withColumn("level", F.regexp_extract("line", r"^\S+ (DEBUG|INFO|WARN|ERROR|FATAL) ", 1)).where("level <> ''")
    return lines.groupBy(key, "level").agg(F.count("*").alias("n"), F.min("n").alias("first_line"))
