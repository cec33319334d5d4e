"""Symbols, imports and calls from source text, and the edges that follow from them.

Files are read in Arrow batches, Python by its own parser and other languages as tokens; what follows from the facts of all
files together is joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.operators import read_tokens

FACTS = "kind string, path string, id string, name string, line int, end_line int, signature string, summary string, tags array<string>, source string, target string, confidence double, via string"
_NAMES = [f.split(" ")[0] for f in FACTS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.string()]

# How sure an edge is, by where it comes from.
CONFIDENCE = {"parsed": 1.0, "pattern": 0.9, "imports_py": 1.0, "imports": 0.9, "external": 0.8, "calls": 0.9, "calls_generic": 0.85, "calls_by_name": 0.8}


def _fact(kind: str, path: str, **values) -> tuple:
    values = {"kind": kind, "path": path} | values
    return tuple(values.get(n) for n in _NAMES)


class _PythonReader(ast.NodeVisitor):
    """Walks a Python file once. The scope at hand is the innermost symbol; functions inside functions are no symbols of
    their own, so that what they call belongs to the function around them."""

    def __init__(self, path: str):
        self.path = path
        self.scope: list[tuple[str, str, str]] = [(path, "file", "")]
        self.facts: list[tuple] = []
        self.calls: list[tuple[str, str, str | None, str]] = []
        self.known: dict[str, str] = {}

    @staticmethod
    def says(node: ast.AST) -> str:
        return (ast.get_docstring(node) or "").strip().split("\n")[0][:200]

    def enter(self, node: ast.AST, name: str, tag: str, signature: str, summary: str) -> None:
        """Take down a symbol, then read what is inside it."""
        parent, _, owner = self.scope[-1]
        qualified = f"{owner}.{name}" if owner else name
        own = f"{self.path}::{qualified}"
        self.known.setdefault(qualified, own)
        self.facts.append(_fact("node", self.path, id=own, name=qualified, line=node.lineno, end_line=node.end_lineno, signature=signature, summary=summary, tags=["python", tag]))
        self.facts.append(_fact("edge", self.path, name="defines", source=parent, target=own, confidence=CONFIDENCE["parsed"]))
        self.scope.append((own, tag, name if tag == "class" else owner))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = self.scope[-1][1]
        if kind not in ("file", "class"):
            self.generic_visit(node)
            return
        decorators, node.decorator_list = node.decorator_list, []
        for d in decorators:
            self.visit(d)
        names = ", ".join(a.arg for a in node.args.args)
        self.enter(node, node.name, "method" if kind == "class" else "func", f"{node.name}({names})", self.says(node))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if self.scope[-1][1] == "file":
            self.enter(node, node.name, "class", node.name, self.says(node))
        else:
            self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign | ast.AnnAssign) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        names = [t.id for t in targets if isinstance(t, ast.Name) and t.id.isupper() and len(t.id) > 2]
        if not names or self.scope[-1][1] != "file" or node.col_offset:
            self.generic_visit(node)
            return
        for name in names[1:]:
            self.enter(ast.Pass(lineno=node.lineno, end_lineno=node.end_lineno), name, "var", name, "")
        self.enter(node, names[0], "var", names[0], "")

    visit_AnnAssign = visit_Assign

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            top = a.name.partition(".")[0]
            self.facts.append(_fact("import", self.path, name=a.name, line=node.lineno))
            self.facts.append(_fact("binding", self.path, name=a.asname or top, source=a.name if a.asname else top))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.facts.append(_fact("import", self.path, name=module, line=node.lineno))
        for a in node.names:
            member = module + a.name if module.endswith(".") else f"{module}.{a.name}"
            self.facts.append(_fact("import", self.path, name=member, line=node.lineno, via="member"))
            self.facts.append(_fact("binding", self.path, name=a.asname or a.name, source=module, target=a.name))

    def visit_Call(self, node: ast.Call) -> None:
        caller, _, owner = self.scope[-1]
        match node.func:
            case ast.Name(id=name):
                self.calls.append((caller, name, None, owner))
            case ast.Attribute(attr=name, value=ast.Name(id=via)):
                self.calls.append((caller, name, via, owner))
        self.generic_visit(node)

    def resolved(self) -> list[tuple]:
        """Calls inside the file as edges, each once; those that may lead out of it as they are."""
        for caller, name, via, owner in dict.fromkeys(self.calls):
            inside = self.known.get(name) if via is None else self.known.get(f"{owner}.{name}") if via == "self" else None
            if inside and inside != caller:
                self.facts.append(_fact("edge", self.path, name="calls", source=caller, target=inside, confidence=CONFIDENCE["parsed"]))
            elif not inside and via != "self":
                self.facts.append(_fact("call", self.path, source=caller, target=name, via=via))
        return self.facts


def python_facts(path: str, text: str) -> list[tuple]:
    """The facts of one Python file: nodes, edges inside the file, imports, calls that lead out of it, and the names that
    imports bind. A file that does not parse gives its file node only."""
    base = path.rsplit("/", 1)[-1]
    try:
        tree = ast.parse(text.lstrip("\ufeff"))
        reader = _PythonReader(path)
        reader.facts.append(_fact("node", path, id=path, name=base, line=1, end_line=text.count("\n") + 1, summary=reader.says(tree), tags=["python"]))
        reader.visit(tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [_fact("node", path, id=path, name=base, line=1, summary="", tags=["python"])]
    return reader.resolved()


_BOUND = re.compile(r"[\w$]+")


def token_facts(path: str, lang: str, text: str) -> list[tuple]:
    """The facts of one file of another language. A call on a name that only this file declares, once, is an edge inside it;
    what an import binds is the last part of its name, or for JavaScript the names in its braces."""
    found = read_tokens.read(path, lang, text)
    facts = [_fact("node", path, id=path, name=path.rsplit("/", 1)[-1], line=1, end_line=text.count("\n") + 1, summary="", tags=[lang])]
    short: dict[str, set[str]] = {}
    for x in {x["id"]: x for x in reversed(found.symbols)}.values():
        facts.append(_fact("node", path, id=x["id"], name=x["name"], line=x["line"], end_line=x["end_line"], signature=x["signature"], summary="", tags=[lang, x["tag"]]))
        facts.append(_fact("edge", path, name="defines", source=x["parent"], target=x["id"], confidence=CONFIDENCE["pattern"]))
        short.setdefault(x["name"].rpartition(".")[2], set()).add(x["id"])
    for source, base in dict.fromkeys(found.bases):
        facts.append(_fact("base", path, source=source, target=base))
    for raw, line in dict.fromkeys(found.imports):
        facts.append(_fact("import", path, name=raw, line=line))
        if lang not in ("javascript", "typescript"):
            facts.append(_fact("binding", path, name=re.split(r"[./\\\\]", raw.rstrip("/"))[-1], source=raw))
    if lang in ("javascript", "typescript"):
        facts += _bound_names(path, text)
    for caller, name, via in dict.fromkeys(found.calls):
        here = short.get(name, set()) if via in (None, "this", "self", "Self", "$this") else set()
        if len(here) == 1 and here != {caller}:
            facts.append(_fact("edge", path, name="calls", source=caller, target=min(here), confidence=CONFIDENCE["pattern"]))
        elif not here and via != "?":
            facts.append(_fact("call", path, source=caller, target=name, via=via))
    return facts


def _bound_names(path: str, text: str) -> list[tuple]:
    """What JavaScript imports bind: every statement that gets a quoted module, cut at its words."""
    out = []
    for part in re.split(r"\bimport\b|\bexport\b|\b(?=const\b|let\b|var\b)", text)[1:]:
        clause, quoted, rest = part.partition("from") if "from" in part[:2000] else part.partition("=")
        module = re.match(r"\s*(?:require\s*\(\s*)?(['\"])([^'\"\n]+)\1", rest)
        if not module or ";" in clause or len(clause) > 2000:
            continue
        outside, _, inside = clause.partition("{")
        for name in inside.partition("}")[0].split(","):
            words = _BOUND.findall(name)
            if words and words[0] != "type":
                out.append(_fact("binding", path, name=words[-1], source=module.group(2), target=words[0]))
        words = [w for w in _BOUND.findall(outside) if w not in ("const", "let", "var", "as", "type")]
        if words:
            out.append(_fact("binding", path, name=words[-1], source=module.group(2)))
    return out


def _run(reader):
    """A job over (path, lang, text) batches that gives the facts of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                rows = [r for one in zip(*(c.to_pylist() for c in b.slice(lo, 200).columns)) for r in reader(*one)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    return run


def python(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The facts of Python files (see :func:`python_facts`), one table with a ``kind``. Null paths and texts give none."""
    return files.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(path, text).mapInArrow(_run(python_facts), FACTS)


def facts(files: DataFrame) -> DataFrame:
    """The facts of files (path, lang, text) of any language that is known, one table with a ``kind``: nodes with their
    spans, edges inside a file, imports, bindings, bases and calls. Null paths and texts give none."""
    known = files.where(F.col("path").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin("python", *read_tokens.LANGUAGES))
    read = lambda path, lang, text: python_facts(path, text) if lang == "python" else token_facts(path, lang, text)
    return known.select("path", "lang", "text").mapInArrow(_run(read), FACTS)


def label_calls(files: DataFrame) -> DataFrame:
    """(path, source, target) of assembly: a call or jump to a label of the file, from the last label before it."""
    from pyspark.sql import Window as W

    lines = files.where("text IS NOT NULL").select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "l"))
    label, to = F.regexp_extract("l", r"^([A-Za-z_.$][\w.$]*):", 1), F.regexp_extract("l", r"(?i)^\s+(?:call|jmp|j[a-z]{1,3}|bl|b|bx|blx)\s+([A-Za-z_.$][\w.$]*)\s*(?:[;#].*)?$", 1)
    lines = lines.withColumn("label", F.when(label != "", label)).withColumn("to", F.when(to != "", to)).where("label IS NOT NULL OR to IS NOT NULL")
    lines = lines.withColumn("source", F.last("label", ignorenulls=True).over(W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    known = lines.where("label IS NOT NULL").select("path", F.col("label").alias("to")).distinct()
    return lines.where("to IS NOT NULL AND source IS NOT NULL AND source <> to").join(known, ["path", "to"]).select("path", "source", F.col("to").alias("target")).distinct()


def _normal(path):
    """A path without . and .. segments; null where it leads above its start."""
    out = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    joined = F.array_join(out, "/")
    return F.when(~joined.startswith(".."), joined)


def _prefixes(parts, joiner: str):
    """All leading runs of an array, the longest first."""
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), joiner))).otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, files: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(path, raw, target, internal): the file of the same project that an import means, or ``external:`` and its package,
    the first part of its name. A relative import that is no file has a null target.

    ``imports`` has path, lang and raw; ``files`` has path. The candidates of an import are listed in order of
    preference and joined with the files at once; the first that is a file wins. ``settings`` (project, prefix, base)
    maps the prefix of an import to a folder: path aliases, the module of Go, the namespaces of PHP."""
    imports = imports.select("path", "lang", "raw").distinct()
    project = F.substring_index("path", "/", 1)
    imports = imports.withColumn("project", project).withColumn("folder", F.regexp_replace(F.expr("substring(path, length(project) + 2)"), "/?[^/]*$", ""))
    if settings is not None:
        s = settings.select("project", "prefix", "base")
        mapped = imports.join(s, "project").where("startswith(raw, prefix)").groupBy("path", "lang", "raw").agg(F.max(F.struct(F.length("prefix").alias("l"), "prefix", "base")).alias("m"))
        imports = imports.join(mapped, ["path", "lang", "raw"], "left")
    else:
        imports = imports.withColumn("m", F.lit(None).cast("struct<l:int,prefix:string,base:string>"))
    raw, folder = F.col("raw"), F.col("folder")
    js = F.regexp_replace(raw, r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    beyond = F.expr("substring(raw, 3)")
    beyond = F.regexp_replace(beyond, r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    under = lambda p: _normal(F.concat(folder, F.lit("/"), p))
    aliased = F.when(F.col("m").isNotNull(), _normal(F.concat(F.col("m.base"), F.lit("/"), F.expr("substring(raw, length(m.prefix) + 1)"))))
    alias_js = F.regexp_replace(aliased, r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    dots = F.length(F.regexp_extract(raw, r"^\.*", 0))
    above = F.split(folder, "/")
    package = F.slice(above, F.lit(1), F.greatest(F.size(above) - dots + 1, F.lit(0)))
    dotted = F.filter(F.split(F.regexp_replace(raw, r"^\.+", ""), r"\."), lambda x: x != "")
    whole = F.filter(F.when(dots > 0, F.concat(package, dotted)).otherwise(dotted), lambda x: x != "")
    ends = lambda c, *more: F.flatten(F.transform(c, lambda x: F.array(*(F.concat(x, F.lit(m)) for m in more))))
    candidates = (
        F.when(F.col("lang") == "python", F.when(dots - 1 > F.size(above), F.array().cast("array<string>")).otherwise(ends(_prefixes(whole, "/"), "", "/__init__")))
        .when(F.col("lang").isin("javascript", "typescript"), F.when(raw.startswith("."), F.array(under(js), F.concat(under(js), F.lit("/index")))).otherwise(F.array(alias_js, F.concat(alias_js, F.lit("/index")), F.when(raw.startswith("@/"), beyond), F.when(raw.startswith("@/"), F.concat(F.lit("src/"), beyond)))))
        .when(F.col("lang") == "java", _prefixes(F.split(raw, r"\."), "/"))
        .when(F.col("lang").isin("c", "cpp", "r"), F.array(F.regexp_replace(under(raw), r"\.[^./]*$", "")))
        .when(F.col("lang") == "rust", F.array(under(raw), under(F.concat(raw, F.lit("/mod")))))
        .when(F.col("lang") == "php", F.array(F.translate(aliased, "\\", "/")))
        .when(F.col("lang") == "go", F.array(F.concat(F.coalesce(aliased, raw), F.lit("/"))))
        .otherwise(F.array().cast("array<string>")))
    each = imports.select("path", "lang", "raw", "project", F.posexplode(F.filter(candidates, lambda c: c.isNotNull() & (c != ""))).alias("rank", "stem"))
    own = files.select(F.col("path").alias("target"), F.substring_index("path", "/", 1).alias("project"))
    stem = F.regexp_replace(F.expr("substring(target, length(project) + 2)"), r"\.[^./]*$", "")
    keys = own.select("project", "target", F.explode(F.array(stem, F.when(F.col("target").endswith(".go"), F.regexp_replace(stem, "[^/]*$", "")))).alias("stem")).where("stem IS NOT NULL")
    keys = keys.groupBy("project", "stem").agg(F.min("target").alias("target"))
    hit = each.join(keys, ["project", "stem"]).groupBy("path", "raw").agg(F.min(F.struct("rank", "target")).alias("m")).select("path", "raw", "m.target")
    out = imports.select("path", "raw", "lang").join(hit, ["path", "raw"], "left")
    package = F.substring_index(F.substring_index(raw, "/", 1), ".", 1)
    outside = F.when(~raw.startswith(".") & (package != ""), F.concat(F.lit("external:"), package))
    return out.select("path", "raw", "lang", F.coalesce("target", outside).alias("target"), F.col("target").isNotNull().alias("internal"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """Edges of resolved imports: imports inside (1.0 Python, else 0.9), depends_on for packages (0.8)."""
    conf = F.when(~F.col("internal"), CONFIDENCE["external"]).when(F.col("lang") == "python", CONFIDENCE["imports_py"]).otherwise(CONFIDENCE["imports"])
    return resolved.where("target IS NOT NULL AND path <> target").select(F.col("path").alias("source"), "target", F.when(F.col("internal"), "imports").otherwise("depends_on").alias("type"), conf.alias("confidence")).distinct()


def call_edges(calls: DataFrame, bindings: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of calls that lead to another file: a name that an import binds, or an attribute of a bound module, where the
    file that is meant has exactly one symbol of that name (0.9).

    ``calls`` has path, source, target (the name called) and via; ``bindings`` has path, name, source (module) and
    target (member); ``resolved`` is what :func:`resolve_imports` gives; ``symbols`` has id, path and name."""
    files = resolved.where("internal").select("path", F.col("raw").alias("module"), F.col("target").alias("file"))
    b = bindings.select("path", F.col("name").alias("bound"), F.col("source").alias("module"), F.col("target").alias("member"))
    member_module = F.concat(F.col("module"), F.when(F.col("module").endswith("."), "").otherwise("."), F.col("member"))
    direct = b.where("member IS NOT NULL").join(files, ["path", "module"]).select("path", "bound", F.col("member").alias("name"), "file", F.lit(False).alias("is_module"))
    module = b.select("path", "bound", F.coalesce(member_module, F.col("module")).alias("module")).join(files, ["path", "module"]).select("path", "bound", F.lit(None).cast("string").alias("name"), "file", F.lit(True).alias("is_module"))
    c = calls.select("path", "source", F.col("target").alias("callee"), "via").withColumn("bound", F.coalesce("via", "callee"))
    bare = c.where("via IS NULL").join(direct, ["path", "bound"]).select("source", "file", "name")
    dotted = c.where("via IS NOT NULL").join(module, ["path", "bound"]).select("source", "file", F.col("callee").alias("name"))
    one = symbols.groupBy(F.col("path").alias("file"), "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1").drop("n")
    return bare.unionByName(dotted).join(one, ["file", "name"]).where("source <> target").select("source", "target", F.lit("calls").alias("type"), F.lit(CONFIDENCE["calls"]).alias("confidence")).distinct()


def call_edges_by_namespace(calls: DataFrame, namespaces: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of calls on a type of C# or Visual Basic: to the one symbol ``Type.method`` in the files of the namespaces that
    the calling file declares or uses (0.8). ``namespaces`` has path, namespace and declared."""
    seen = namespaces.select("path", F.substring_index("path", "/", 1).alias("project"), "namespace").distinct()
    holds = namespaces.where("declared").select(F.col("path").alias("file"), F.substring_index("path", "/", 1).alias("project"), "namespace").distinct()
    c = calls.where("lang IN ('csharp', 'vb') AND via IS NOT NULL").select("path", "source", F.concat("via", F.lit("."), "target").alias("name")).distinct()
    meant = c.join(seen, "path").join(holds, ["project", "namespace"]).select("source", "name", "file").distinct()
    hit = meant.join(symbols.select("id", F.col("path").alias("file"), "name"), ["file", "name"]).where("id <> source")
    one = hit.groupBy("source", "name").agg(F.min("id").alias("target"), F.max("id").alias("__z")).where("target = __z")
    return one.select("source", "target", F.lit("calls").alias("type"), F.lit(CONFIDENCE["calls_by_name"]).alias("confidence")).distinct()


def call_edges_by_import(calls: DataFrame, bindings: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of calls from languages other than Python to another file.

    A call on what an import binds means the one symbol of that short name in the file that is imported (0.85; in Go any
    file of the folder). JavaScript binds names, and there a top-level symbol is meant (0.9). A free call of C, C++ or R means
    the one symbol of that name in the included files and those that are called like them apart from their ending (0.8). Where
    several are meant there is no edge. ``calls`` has path, lang, source, target and via; ``bindings`` path, name, source and
    target; ``resolved`` is what :func:`resolve_imports` gives; ``symbols`` has id, path and name."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    inside = resolved.where("internal").select("path", F.col("raw").alias("module"), F.col("target").alias("file"))
    place = F.when(F.col("file").endswith(".go"), F.regexp_replace("file", "[^/]*$", "")).otherwise(F.col("file"))
    s = symbols.where("contains(id, '::')").select("id", F.col("path").alias("file"), "name").distinct()
    short = s.select("id", "file", F.substring_index("name", ".", -1).alias("callee"), F.col("name").contains(".").alias("is_member"))
    c = calls.select("path", "lang", "source", F.col("target").alias("callee"), "via")
    js = F.col("lang").isin("javascript", "typescript")
    b = bindings.select("path", F.col("name").alias("bound"), F.col("source").alias("module"), F.col("target").alias("member")).distinct()
    bound = c.withColumn("bound", F.coalesce("via", "callee")).where("lang <> 'python' AND NOT (via IS NULL AND lang IN ('c', 'cpp', 'r'))").join(b, ["path", "bound"]).join(inside, ["path", "module"])
    bound = bound.select("source", "lang", place.alias("place"), F.coalesce("member", "callee").alias("callee")).distinct()
    at = short.select("id", F.when(F.col("file").endswith(".go"), F.regexp_replace("file", "[^/]*$", "")).otherwise(F.col("file")).alias("place"), "callee", "is_member")
    by_import = bound.join(at, ["place", "callee"]).where(~js | ~F.col("is_member")).select("source", "callee", "id", F.when(js, CONFIDENCE["calls"]).otherwise(CONFIDENCE["calls_generic"]).alias("confidence"))
    included = inside.select("path", stem(F.col("file")).alias("stem")).distinct()
    free = c.where("via IS NULL AND lang IN ('c', 'cpp', 'r')").join(included, "path").join(short.select("id", stem(F.col("file")).alias("stem"), "callee"), ["stem", "callee"])
    both = by_import.unionByName(free.select("source", "callee", "id", F.lit(CONFIDENCE["calls_by_name"]).alias("confidence"))).where("id <> source")
    one = both.groupBy("source", "callee", "confidence").agg(F.min("id").alias("target"), F.max("id").alias("__z")).where("target = __z")
    return one.groupBy("source", "target").agg(F.max("confidence").alias("confidence")).select("source", "target", F.lit("calls").alias("type"), "confidence")


def heritage_edges(bases: DataFrame, bindings: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges from a type to the one type that its base means: in its own file, else where the name was imported from."""
    s = symbols.where("contains(id, '::')").select("id", F.col("path").alias("file"), F.col("name").alias("base")).distinct()
    own = bases.select("path", "source", F.col("target").alias("base"))
    here = own.join(s.withColumnRenamed("file", "path"), ["path", "base"]).select("source", "base", "id")
    b = bindings.select("path", F.col("name").alias("base"), F.col("source").alias("module"), F.coalesce("target", "name").alias("named")).distinct()
    there = own.join(b, ["path", "base"]).join(resolved.where("internal").select("path", F.col("raw").alias("module"), F.col("target").alias("file")), ["path", "module"])
    there = there.select("source", F.col("named").alias("base"), "file").join(s, ["file", "base"]).select("source", "base", "id")
    one = here.unionByName(there).where("id <> source").groupBy("source", "base").agg(F.min("id").alias("target"), F.max("id").alias("__z")).where("target = __z")
    return one.select("source", "target", F.lit("implements").alias("type"), F.lit(CONFIDENCE["pattern"]).alias("confidence")).distinct()
