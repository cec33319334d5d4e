"""Source files that nobody wrote by hand in their project: generated, minified, copied from elsewhere, or data.

Copies are found by content: every file is a small tree (runs of its lines, pairs of neighbouring runs above them, the
file above these) inside the tree of directories, with Merkle hashes from the bottom up. A node that occurs in more than
one project marks what is below it as copied. Header and layout rules tell the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.session import cut

#: Folders that generators write to, and file names that they give.
GENERATED_PATH = (r"(^|/)(gen|generated|__generated__|autogen|codegen|build/classes|build/generated|target/codegen|target/generated\w*)/"
                  r"|(^|/)zz_generated[_.]|_pb2(_grpc)?\.\w+$|\.pb\.\w+$|\.g\.\w+$|\.generated\.\w+$|_(stub|gen)\.\w+$")
MINIFIED_PATH = r"\.min\.\w+$|\.bundle\.\w+$|-[0-9a-f]{8,}\.(js|mjs|cjs|css)$"
#: Folders of third-party code: a library's own folder must follow.
VENDOR_PATH = r"(^|/)(node_modules|vendor|_vendor|third_party|thirdparty|extern|deps|bower_components|site-packages)/[^/]+/"

# What a header says is read as small sentences over these classes of words.
_MADE = r"(?:generated|emitted|produced|created|written|compiled|rendered|derived)"
_SELF = r"(?:automatically|mechanically|programmatically|machine|auto)"
_WORK = r"(?:code|file|source|module|output|client|stubs?|bindings?)"
_CHANGE = r"(?:edit|modify|alter|change|touch)"
_EDITS = r"(?:edits?|changes?|modifications?)"
_GONE = r"(?:lost|overwritten|discarded|replaced|reverted|undone|clobbered)"
_HAND = r"(?:by hand|manually|directly|freely)"
#: A tool made this, or nobody may change it since it would be made again.
GENERATED_MARK = "(?i)" + "|".join((
    r"@generated\b", rf"<?\bauto-?{_MADE}\b", rf"\b{_SELF}[- ]{_MADE}\b", rf"\b{_SELF}[- ](?:output|made)\b",
    rf"\b{_WORK}\s+(?:is |was |has been )?{_MADE} (?:by|from|with|using)\b", rf"\b{_MADE} by \S+ (?:\S+ )?(?:at|from|during|for|using|with)\b",
    rf"\b(?:do not|don't|never|must not) (?:manually |hand-?)?(?:edit|modify|alter)\b", rf"\bre-?generate\b.*\b(?:do not|don't|never) {_CHANGE}\b",
    rf"\b{_EDITS} (?:made )?(?:here |to this file |in this file )?(?:will|are|get|may)(?: be)? {_GONE}\b",
    r"\bgenerado autom", r"\bno (?:modificar|editar) a mano", r"\bg[eé]n[eé]r[eé] automatiquement", r"\bne pas modifier\b", r"\bautomatisch (?:generiert|erzeugt)", r"\bnicht (?:bearbeiten|ändern)\b"))
#: The opposite: people keep it, or it stands beside what a tool made.
NOT_GENERATED_MARK = "(?i)" + "|".join((
    rf"\b(?:not|never|no longer|isn't|wasn't) (?:auto-?|{_SELF}[- ])?{_MADE}\b", rf"\b{_MADE} (?:only )?once\b", rf"\b{_HAND} since\b", rf"\b(?:maintained|kept|written|edited) {_HAND}\b",
    rf"\b(?:around|beside|over|on top of|wraps?|uses?|calls?) (?:the |a |an |our )?(?:auto-?)?{_MADE} {_WORK}\b", rf"\b{_CHANGE} (?:this|it)(?: file)? {_HAND}\b"))
#: A closing comment: the end of what was made, a map to its source, or a digest over it.
TRAILER_MARK = rf"(?i)\bend of (?:auto-?)?{_MADE} {_WORK}\b|\bsourceMappingURL=|\b(?:source )?(?:checksum|digest)\b.*\b[0-9a-f]{{8,}}\b"
NOTICE = r"(?i)\(c\)|©|\bcopyright\b"
LICENCE = r"(?i)\blicen[cs]ed?\b|\bredistribution\b|\bwarranty\b"
OWN_NOTICE = r"(?i)\binternal (use|code)\b"
#: A quoted text in a comment is talked about, not said.
_QUOTED = r"(?<=[ \t:(=])\"(?!\"\")[^\"\n]+\""

#: What declares a function; names that are none.
FUNCTIONS = (r"(?m)^(?:(?:export|default|async|public|private|protected|static|final|abstract|synchronized|const|unsafe|pub(?:\([^)\n]*\))?) +)*(?:def|function *\*?|func|fn) +(?:\([^)\n]*\) *)?([A-Za-z_$][\w$]*)",
             r"(?m)^(?:export +)?(?:default +)?(?:const|let|var) +([A-Za-z_$][\w$]*) *(?::[^=\n]+)?= *(?:async *)?(?:\([^;\n]*=>|[A-Za-z_$][\w$]* *=>|function\b)",
             r"(?m)^(?!(?:if|for|while|switch|catch|function|return|else|match|loop|with|do|try)\b)(?:(?:public|private|protected|static|final|abstract|synchronized|async|get|set|override|readonly) +)*(?:[\w<>\[\],.?]+ +)?([A-Za-z_$][\w$]*) *\([^;{\n]*\) *(?::[^{;=\n]+|throws +[\w, .]+)? *\{")
#: Functions from which a file is generated if all of their names contain the first word of its own.
NAMED_ALIKE = 4

#: A run of lines ends at an empty line, or behind a line whose hash is divisible by the first number, so that runs find
#: each other again after a patch; one of fewer characters than the second goes on.
RUN_LINES, RUN = 32, 50
#: Share of a file's nodes, by length, that must occur in another project; the rest may be patched.
COPIED_SHARE = 0.4
#: Median length of a code line from which a file is minified if white space is at most this share of it.
LONG_LINES, BLANK = 120, 0.12
#: Share of literals from which code is data, if there are so many of them or one that is longer than a long line.
LITERALS, LEAST_LITERALS = 0.55, 10

_COMMENT = r"^(//|#|/\*|\*|<!--|;;|--|\"\"\")"


def project_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def _marked(sources: DataFrame, path: str, text: str) -> DataFrame:
    """(path, project, generated, minified, data, foreign, nodes, h, n) of each row: what header, name and layout say, the
    nodes of the file's tree, its own hash and the length of its code."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^﻿", ""), "\r\n?", "\n")
    df = sources.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), project_of(F.col(path)).alias("project"), F.split(body, "\n").alias("raw"))
    df = df.select("path", "project", F.transform("raw", lambda x: F.trim(x, F.lit(" \t\f\v\r"))).alias("trimmed"))
    df = df.withColumn("lines", F.filter("trimmed", lambda x: x != ""))
    df = df.withColumn("is_code", F.transform("lines", lambda x: ~x.rlike(_COMMENT)))
    first, last = F.array_position("is_code", True).cast("int"), F.array_position(F.reverse("is_code"), True).cast("int")
    size = F.size("lines")
    df = df.withColumn("header", F.array_join(F.when(first == 0, F.col("lines")).otherwise(F.slice("lines", F.lit(1), first - 1)), "\n"))
    df = df.withColumn("trailer", F.array_join(F.when(last <= 1, F.array().cast("array<string>")).otherwise(F.slice("lines", size - last + 2, last - 1)), "\n"))
    df = df.withColumn("code", F.filter("lines", lambda x, i: F.get("is_code", i)))
    df = df.withColumn("joined", F.array_join("code", "\n"))
    header = F.regexp_replace("header", _QUOTED, "")
    said = header.rlike(GENERATED_MARK) & ~header.rlike(NOT_GENERATED_MARK)
    ended = F.col("trailer").rlike(TRAILER_MARK) & ~header.rlike(NOT_GENERATED_MARK)
    own = F.exists(F.split("header", "\n"), lambda x: x.rlike(OWN_NOTICE) | (x.rlike(NOTICE + r"|\bpart of\b") & x.contains(F.col("project"))))
    notice = F.col("header").rlike(NOTICE) & F.col("header").rlike(LICENCE) & ~own
    stem = F.regexp_extract(F.lower(F.substring_index("path", "/", -1)), r"^(?:zz_generated_)?([a-z]{3,})", 1)
    lower = F.lower("joined")
    often = (stem != "") & (F.length(lower) - F.length(F.replace(lower, stem, F.lit(""))) >= NAMED_ALIKE * F.length(stem))
    named = F.flatten(F.array(*(F.regexp_extract_all("joined", F.lit(p), F.lit(1)) for p in FUNCTIONS)))
    alike = F.when(often, (F.size(named) >= NAMED_ALIKE) & F.forall(named, lambda n: F.lower(n).contains(stem))).otherwise(False)
    widths = F.array_sort(F.transform("code", F.length))
    median = F.coalesce(F.get(widths, F.floor(F.size(widths) / 2).cast("int")), F.lit(0))
    dense = F.length(F.regexp_replace("joined", r"\s+", "")) >= (1 - BLANK) * F.length("joined")
    literal = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`]*+`|\b0[xX][0-9a-fA-F]++\b|[-+]?\b\d++(?:\.\d++)?\b"
    bare = F.regexp_replace("joined", literal, "\x01")
    n_literals = F.length(bare) - F.length(F.replace(bare, F.lit("\x01"), F.lit("")))
    table = (F.length("joined") - F.length(bare) + n_literals >= LITERALS * F.length("joined")) & ((n_literals >= LEAST_LITERALS) | F.col("joined").rlike(rf"([\"'`])[^\"'`\n]{{{LONG_LINES},}}\1"))
    # A file without code is the tree of its comments, so that what is equal counts whatever it is.
    units = F.when(F.size("code") > 0, F.filter("trimmed", lambda x: (x == "") | ~x.rlike(_COMMENT))).otherwise(F.col("trimmed"))
    ends = F.array_join(F.transform(units, lambda x: F.when(F.pmod(F.xxhash64(x), F.lit(RUN_LINES)) == 0, F.concat(x, F.lit("\n"))).otherwise(x)), "\n")
    runs = F.transform(F.regexp_extract_all(ends, F.lit(rf"(?s).{{{RUN},}}?(?:\n\n|\z)|.+\z"), F.lit(0)), lambda x: F.trim(x, F.lit("\n")))
    runs = F.filter(runs, lambda b: b != "")
    leaves = F.transform(runs, lambda b: F.struct(F.xxhash64(b).alias("h"), F.length(b).alias("n")))
    df = df.select(
        "path", "project", (said | ended | alike | F.col("path").rlike(GENERATED_PATH)).alias("generated"),
        (((median >= LONG_LINES) & dense) | F.col("path").rlike(MINIFIED_PATH)).alias("minified"), table.alias("data"),
        (notice | (F.col("path").rlike(VENDOR_PATH) & ~own)).alias("foreign"), leaves.alias("leaves"))
    pairs = F.transform(F.slice("leaves", F.lit(2), F.greatest(F.size("leaves") - 1, F.lit(0))), lambda b, i: F.struct(F.xxhash64(F.get("leaves", i)["h"], b["h"]).alias("h"), (F.get("leaves", i)["n"] + b["n"]).alias("n")))
    return df.select("path", "project", "generated", "minified", "data", "foreign", F.when(F.size("leaves") > 1, pairs).otherwise(F.col("leaves")).alias("nodes"),
                     F.xxhash64(F.transform("leaves", lambda b: b["h"])).alias("h"), F.aggregate("leaves", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]).alias("n"))


def _shared(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in more than one project; hot keys are combined before the shuffle."""
    return nodes.groupBy(*keys).agg(F.min("project").alias("__a"), F.max("project").alias("__z")).where("__a <> __z").select(*keys)


def _copied_files(files: DataFrame) -> DataFrame:
    """(path): files that another project has as well, or that share ``COPIED_SHARE`` of their inner nodes with others."""
    whole = F.array(F.struct(F.xxhash64("h", F.lit("file")).alias("h"), F.col("n"), F.lit(True).alias("whole")))
    inner = F.transform("nodes", lambda x: F.struct(x["h"].alias("h"), x["n"].cast("bigint").alias("n"), F.lit(False).alias("whole")))
    each = files.where("n > 0").select("path", "project", F.explode(F.concat(whole, inner)).alias("x")).select("path", "project", "x.h", "x.n", "x.whole")
    shared = _shared(each, ["h", "n"]).select("h", "n", F.lit(True).alias("hit"))
    share = each.join(shared, ["h", "n"], "left").groupBy("path").agg(
        F.sum(F.when(~F.col("whole"), F.col("n"))).alias("all"), F.sum(F.when(~F.col("whole") & F.col("hit"), F.col("n"))).alias("met"), F.max(F.col("whole") & F.col("hit")).alias("same"))
    return share.where(F.col("same") | (F.col("met") >= COPIED_SHARE * F.col("all"))).select("path")


def directory_nodes(files: DataFrame) -> DataFrame:
    """(path, project, dir, c1, c2, n): what each file adds to each directory above it, projects themselves aside.

    ``files`` has path, project, h (the file's own hash) and n (its text in characters). A file's hash is hashed with its
    name, the result with the name of its folder, and so on up to below the directory, each time twice with different
    mixing. The exclusive or over the files of a directory is its Merkle hash; so all levels are one aggregate, and a
    directory with any number of files is combined before the shuffle. The directory's own name is no part of it."""
    seg = F.split("path", "/")
    up = files.select("path", "project", "h", "n", seg.alias("seg"), F.explode(F.when(F.size(seg) > 2, F.sequence(F.lit(2), F.size(seg) - 1))).alias("k"))
    below = F.reverse(F.slice("seg", F.col("k") + 1, F.size("seg")))
    fold = lambda start, mix: F.aggregate(below, start, mix)
    return up.select("path", "project", F.array_join(F.slice("seg", F.lit(1), F.col("k")), "/").alias("dir"), fold(F.col("h"), lambda c, s: F.xxhash64(s, c)).alias("c1"), fold(F.xxhash64("h", F.lit(2)), lambda c, s: F.xxhash64(c, s)).alias("c2"), "n")


def directory_hashes(nodes: DataFrame) -> DataFrame:
    """(project, dir, h1, h2, n): the Merkle hashes of directories, and the text below them."""
    return nodes.groupBy("project", "dir").agg(F.bit_xor("c1").alias("h1"), F.bit_xor("c2").alias("h2"), F.sum("n").alias("n"))


def _copied_trees(files: DataFrame) -> DataFrame:
    """(path): files below a directory that another project has as well; empty files are copied with their directory."""
    nodes = directory_nodes(files.select("path", "project", "h", "n").distinct())
    dirs = directory_hashes(nodes).where("n > 0")
    shared = dirs.join(_shared(dirs, ["h1", "h2", "n"]), ["h1", "h2", "n"], "left_semi").select("dir")
    return nodes.select("path", "dir").join(shared, "dir", "left_semi").select("path")


def not_handwritten(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, generated, minified, vendored, data, copied) for each path, five booleans.

    *copied*: content that another project has as well: the file, whatever its length; a directory above it; or
    ``COPIED_SHARE`` of its inner nodes, so that patched copies count. *vendored*: copied, or a foreign notice, or a
    library's folder below a vendor folder without the project's own notice. *generated*: the leading or the closing
    comment says so, or a generator's folder or file name, or functions that are all named after the file
    (``NAMED_ALIKE`` at least); comments that say the opposite win over marks in comments. *minified*: long lines with
    hardly any white space, or a bundler's file name. *data*: mostly literals. The project is the first segment of the path.

    A null or empty text is judged by its path and its directory. Null paths are left out. Repeated rows are one; of several
    texts of one path any that shows a mark counts. Comments are compared only in files without code. Nothing is compared
    pair by pair: content that many projects share is one key with partial aggregates. The texts are read once and whole:
    what is known of each file goes to the shared folder. Extra columns are ignored."""
    rows = cut(_marked(sources, path, text))
    none = F.lit(False)
    copied = _copied_files(rows).unionByName(_copied_trees(rows)).select("path", none.alias("generated"), none.alias("minified"), none.alias("data"), none.alias("foreign"), F.lit(True).alias("copied"))
    both = rows.select("path", "generated", "minified", "data", "foreign", none.alias("copied")).unionByName(copied)
    out = both.groupBy("path").agg(*(F.max(c).alias(c) for c in ("generated", "minified", "data", "foreign", "copied")))
    return out.select("path", "generated", "minified", (F.col("foreign") | F.col("copied")).alias("vendored"), "data", "copied")
