"""Reading what a graph is made from: source trees, documents, reports of tests, glossaries and logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.functions.scalar import content_hash

# Folders that are not read, and the language of each file ending.
EXCLUDED = (
    "node_modules", ".git", "venv", ".venv", "__pycache__", "dist", "build", "worktrees", "public", "logs", "data", "temp", "coverage", "assets", ".pytest_cache",
    ".claude", "documentacion", ".next", ".nuxt", ".svelte-kit", ".output", ".turbo", ".astro", ".vercel", ".netlify", ".angular", ".expo", ".parcel-cache", ".docusaurus", ".cache", "storybook-static",
)
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go", ".java": "java", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".php": "php", ".r": "r", ".cs": "csharp", ".vb": "vb", ".asm": "asm", ".s": "asm",
}


def language(path: Column) -> Column:
    """The language of a path by its ending, or null."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def tree(spark: SparkSession, root: str, project: str, languages: bool = True, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, project, ext, lang, text, content_hash) of the files below a root, without those in excluded folders; paths
    are project/relative. With ``languages`` only files of a known language."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + _quoted(base) + "/", "")
    df = raw.select(rel.alias("rel"), F.col("content").cast("string").alias("text"))
    folders = F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1)
    df = df.where(~F.coalesce(F.arrays_overlap(folders, F.array(*map(F.lit, excluded))), F.lit(False)))
    df = df.select(F.concat(F.lit(project + "/"), F.col("rel")).alias("path"), F.lit(project).alias("project"), F.regexp_extract("rel", r"\.([^./]+)$", 1).alias("ext"), language(F.col("rel")).alias("lang"), "text", content_hash(F.col("text")).alias("content_hash"))
    return df.where("lang IS NOT NULL") if languages else df


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def without_ignored(files: DataFrame, ignored: DataFrame, unignore: tuple[str, ...] = ()) -> DataFrame:
    """Files without those that are ignored (``ignored``: path), but with those below a prefix of ``unignore``."""
    kept = F.lit(False)
    for p in unignore:
        kept |= F.col("path").startswith(p)
    return files.join(ignored.where(~kept).select("path").distinct(), "path", "left_anti")


def markdown(spark: SparkSession, root: str, project: str) -> DataFrame:
    """The documents of a tree: .md and .markdown."""
    return tree(spark, root, project, languages=False).where(F.lower("ext").isin("md", "markdown"))


def git_log(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Commits (sha, author, date, subject, seq) and their files (sha, old_path, new_path) from records of a log that was
    exported with the format ``%x1e%H%x1f%an%x1f%ad%x1f%s`` and ``--numstat``: one record for each row of ``lines``."""
    from weft.operators.temporal import as_date, expand_rename

    head = F.split(F.split(F.regexp_replace(text, "^\x1e", ""), "\n")[0], "\x1f")
    rows = lines.where(F.size(head) >= 4).select(head.alias("h"), F.slice(F.split(text, "\n"), F.lit(2), F.size(F.split(text, "\n"))).alias("f"))
    commits = rows.select(F.col("h")[0].alias("sha"), F.col("h")[1].alias("author"), as_date(F.col("h")[2]).alias("date"), F.col("h")[3].alias("subject"))
    stat = rows.select(F.col("h")[0].alias("sha"), F.explode("f").alias("l")).where(F.col("l").rlike("^[0-9-]+\t[0-9-]+\t."))
    old, new = expand_rename(F.regexp_replace("l", "^[0-9-]+\t[0-9-]+\t", ""))
    return commits, stat.select("sha", F.when(old != new, old).alias("old_path"), new.alias("new_path"))


def hunks(shows: DataFrame, sha: str, text: str) -> DataFrame:
    """(sha, path, a, b): lines after each change, from ``git show --unified=0``; a change that only removes has none."""
    from pyspark.sql import Window as W

    lines = shows.select(F.col(sha).alias("sha"), F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.col("line").rlike(r"^(\+\+\+ |@@ )"))
    file = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    lines = lines.withColumn("path", F.last(file, ignorenulls=True).over(W.partitionBy("sha").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    at = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    n = F.when(F.regexp_extract("line", at, 2) == "", 1).otherwise(F.regexp_extract("line", at, 2).try_cast("int"))
    found = lines.where(F.col("line").startswith("@@ ")).select("sha", "path", F.regexp_extract("line", at, 1).try_cast("int").alias("a"), n.alias("n"))
    return found.where("n > 0 AND path <> '/dev/null'").select("sha", "path", "a", (F.col("a") + F.col("n") - 1).alias("b"))


def blame(porcelain: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, sha) from ``git blame --line-porcelain``."""
    lines = porcelain.select(F.col(path).alias("path"), F.explode(F.split(text, "\n")).alias("l")).where(F.col("l").rlike(r"^[0-9a-f]{40} \d+ \d+"))
    part = F.split("l", " ")
    return lines.select("path", part[2].cast("int").alias("line"), part[0].alias("sha"))


def status(porcelain: DataFrame, text: str = "value") -> DataFrame:
    """(state, path) from ``git status --porcelain``; of a rename the new path."""
    p = F.regexp_replace(F.substring_index(F.expr(f"substring({text}, 4)"), " -> ", -1), '^"|"$', "")
    return porcelain.where(F.length(text) > 3).select(F.trim(F.substring(text, 1, 2)).alias("state"), p.alias("path"))


def cobertura(reports: DataFrame, text: str = "text") -> DataFrame:
    """(path, line, hits) from Cobertura reports, one document a row; the greatest hits of a line."""
    schema = "packages STRUCT<package: ARRAY<STRUCT<classes: STRUCT<class: ARRAY<STRUCT<_filename: STRING, lines: STRUCT<line: ARRAY<STRUCT<_number: INT, _hits: INT>>>>>>>>>"
    x = reports.select(F.from_xml(F.col(text), schema, {"mode": "PERMISSIVE"}).alias("x")).select(F.explode("x.packages.package").alias("p")).select(F.explode("p.classes.class").alias("c"))
    return x.select(F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l")).groupBy("path", F.col("l._number").alias("line")).agg(F.max("l._hits").alias("hits"))


def junit(reports: DataFrame, text: str = "text") -> DataFrame:
    """(file, classname, name, status, pos) from JUnit reports, one document a row: passed, failed, error or skipped.

    Suites may lie inside suites. The last child of a case that tells a status decides. ``pos`` grows over the cases of a
    report and over the reports in their order, so that of several runs of one case the last can be told. A text that is no
    XML, or null, gives nothing."""
    from xml.etree import ElementTree

    told = {"failure": "failed", "error": "error", "skipped": "skipped"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for report, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = ElementTree.fromstring(t or "")
                except ElementTree.ParseError:
                    continue
                for n, case in enumerate(root.iter("testcase")):
                    status = [told[child.tag] for child in case if child.tag in told]
                    rows.append((case.get("file"), case.get("classname"), case.get("name"), status[-1] if status else "passed", report, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.string()] * 4, pa.int64(), pa.int64()))], ["file", "classname", "name", "status", "report", "n"])

    cases = reports.select(F.monotonically_increasing_id(), F.col(text).cast("string")).mapInArrow(read, "file string, classname string, name string, status string, report bigint, n bigint")
    return cases.select("file", "classname", "name", "status", (F.col("report").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("n")).alias("pos"))


def coverage_contexts(reports: DataFrame, text: str = "text") -> DataFrame:
    """(path, line, context) from coverage reports with contexts in JSON; what stands behind a bar is dropped, empty
    contexts as well."""
    x = reports.select(F.from_json(text, "files MAP<STRING, STRUCT<contexts: MAP<STRING, ARRAY<STRING>>>>").alias("x"))
    f = x.select(F.explode("x.files").alias("path", "v")).select("path", F.explode("v.contexts").alias("line", "c")).select("path", F.col("line").cast("int").alias("line"), F.explode("c").alias("context"))
    return f.select("path", "line", F.trim(F.substring_index("context", "|", 1)).alias("context")).where("context <> ''").distinct()


def glossary(documents: DataFrame, text: str = "text") -> DataFrame:
    """(entity, description, aliases) from glossaries in JSON."""
    x = documents.select(F.from_json(text, "entities MAP<STRING, STRUCT<description: STRING, aliases: ARRAY<STRING>>>").alias("x"))
    return x.select(F.explode("x.entities").alias("entity", "v")).select("entity", "v.description", F.coalesce("v.aliases", F.array().cast("array<string>")).alias("aliases"))
