"""Knowledge from documents and glossaries: decisions, conventions, what they govern, entities and endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.functions.scalar import endpoint, first_sentence, role, slug

# What a heading of a decision and a line with a rule contain, and how many of each a document gives.
DECISION_HEADING = r"(?i)(decis|arquitect|architect|\badr\b|rationale|por\s+qu[eé]|motiv|elecc|trade|dise[ñn]o|design|approach|enfoque|estrateg)"
RULE = r"(?i)\b(siempre|nunca|no\s+(se|debe|debes|uses|usar)|deb[eé]|deben|evita|evitar|oblig|prohib|import(ante|a)|regla|convenci|must|never|always|should|do\s+not|don't|required|ensure|avoid)\b"
MAX_DECISIONS, MAX_CONVENTIONS, MAX_MODELS = 25, 40, 60
SECTION_LINES, SHORTEST = 11, 15
# The characters of words and file names, and all others.
RUN, NO_RUN = r"[\w\-.]", r"[^\w\-.]"
# Fixed value: what a path literal in source text looks like.
PATH_LITERAL = r"['\"`](https?://[^'\"`]+|/[A-Za-z0-9][\w\-/]{2,})['\"`]"


def document_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n from 1, line)."""
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(body, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def decisions(docs: DataFrame, key: str, text: str, heading: str = DECISION_HEADING, limit: int = MAX_DECISIONS) -> DataFrame:
    """(key, n, heading, slug, summary): headings of up to four marks that match, the first ``limit`` of a document, with
    the first sentence of up to eleven lines below, up to the next heading.

    Sections are numbered by a running count of headings in each document."""
    lines = document_lines(docs, key, text)
    title = F.regexp_extract("line", r"^(#{1,4})\s+(.*)", 2)
    at = W.partitionBy(key).orderBy("n")
    lines = lines.withColumn("head", F.col("line").rlike(r"^#{1,4}\s")).withColumn("sec", F.sum(F.col("head").cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    sec = lines.where("sec > 0").groupBy(key, "sec").agg(F.min("n").alias("n"), F.max(F.when(F.col("head"), F.regexp_replace(F.trim(title), r"\s*#*\s*$", ""))).alias("heading"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("n", "line")))).alias("body"))
    body = F.array_join(F.transform(F.filter("body", lambda x: x["n"] <= F.col("n") + SECTION_LINES), lambda x: x["line"]), " ")
    hit = sec.where(F.col("heading").rlike(heading)).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("n"))).where(F.col("r") <= limit)
    s = first_sentence(body)
    return hit.select(key, "n", "heading", slug(F.col("heading")).alias("slug"), F.when(s != "", s).otherwise(F.col("heading")).alias("summary"))


def conventions(docs: DataFrame, key: str, text: str, rule: str = RULE, limit: int = MAX_CONVENTIONS) -> DataFrame:
    """(key, n, convention): lines with the language of rules, without bullets and markup, fifteen characters or more,
    the first ``limit`` of a document."""
    lines = document_lines(docs, key, text).withColumn("s", F.trim("line")).where((F.length("s") >= SHORTEST) & ~F.col("s").startswith("#") & F.col("s").rlike(rule))
    clean = F.trim(F.regexp_replace(F.regexp_replace("s", r"^([-*+]|[0-9]+\.)\s+", ""), "[`*_]", ""))
    lines = lines.withColumn("convention", clean).where(F.length("convention") >= SHORTEST)
    return lines.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("n"))).where(F.col("r") <= limit).select(key, "n", F.substring("convention", 1, 200).alias("convention"))


def relates_to(found: DataFrame, key: str, kind: str, place: Column) -> DataFrame:
    """Edges from each decision (0.8) or convention (0.7) of a document to the document; ``place`` tells it apart there."""
    sure = {"decision": 0.8, "convention": 0.7}[kind]
    return found.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"), F.lit("#" if kind == "decision" else ":"), place.cast("string")).alias("source"), F.concat(F.lit("doc:"), F.col(key).cast("string")).alias("target"), F.lit("relates_to").alias("type"), F.lit(sure).alias("confidence")).distinct()


def governs(texts: DataFrame, key: str, text: str, files: DataFrame, shortest: int = 5) -> DataFrame:
    """Edges from a text to the file whose name it mentions (0.6), one file for each name, the least.

    Words of the text that look like file names are joined with the names: an equi-join, so that neither side is
    compared with all of the other."""
    names = files.select(F.lower(F.substring_index("id", "/", -1)).alias("base"), "id").where(F.length("base") >= shortest).groupBy("base").agg(F.min("id").alias("target"))
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\w\-.]+\.\w+"), F.lit(0)))
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("source"), F.explode(found).alias("base")).join(names, "base").select("source", "target", F.lit("governs").alias("type"), F.lit(0.6).alias("confidence"))


def governs_documents(texts: DataFrame, key: str, text: str, files: DataFrame, shortest: int = 5) -> DataFrame:
    """Edges from a text to the file whose name stands anywhere in it, inside longer words as well (0.6), one file for
    each name, the least. ``files`` has path.

    Texts and names are cut into runs of word characters and runs of others, so the longest run of a name lies within
    one run of each text that has the name. The distinct runs are joined with the first characters of the longest runs,
    as many as the shortest has or a power of two, and then tested in full; only names of several runs are looked up in
    whole texts. Only the lengths and whether there are such names go to the driver."""
    low = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("source"), F.lower(F.col(text)).alias("low"))
    edge = ("source", "target", F.lit("governs").alias("type"), F.lit(0.6).alias("confidence"))
    of = lambda c, least: F.regexp_extract_all(c, F.lit(f"{RUN}{{{least},}}|{NO_RUN}{{{least},}}"), F.lit(0))
    longest = F.array_max(F.transform(of(F.col("base"), 1), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    names = files.where("path IS NOT NULL").select(F.lower(F.substring_index("path", "/", -1)).alias("base"), "path").where(F.length("base") >= shortest).groupBy("base").agg(F.min("path").alias("target"))
    names = names.withColumn("name", longest["run"])
    seen = names.agg(F.min(F.length("name")).alias("least"), F.max(F.length("name")).alias("most"), F.coalesce(F.max(F.col("name") != F.col("base")), F.lit(False)).alias("several")).first()
    least, most = seen.least or 1, seen.most or 1
    sizes = [least] + [n for n in (2**k for k in range(most.bit_length())) if least < n <= most]
    names = names.withColumn("piece", F.substring(F.col("name"), F.lit(1), F.greatest(*(F.when(F.length("name") >= n, n) for n in sizes), F.lit(0))))
    runs = low.select("source", F.explode(F.array_distinct(of(F.col("low"), least))).alias("run"))
    # A long run is cut into windows that overlap by the longest piece, so that no row has the pieces of a whole text.
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / most).cast("int"))).alias("w")
    parts = runs.select("run").distinct().select("run", at).select("run", F.substring(F.col("run"), F.col("w") * most + 1, F.lit(2 * most - 1)).alias("part"))
    cuts = F.flatten(F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("part")), lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.substring(F.col("part"), i, n))))
    pieces = parts.select("run", F.explode(F.array_distinct(cuts)).alias("piece"))
    hit = pieces.join(names, "piece").where(F.contains("run", "name")).select("run", "base", "target", (F.col("name") != F.col("base")).alias("several")).distinct()
    found = runs.join(hit, "run").select("source", "base", "target", "several").distinct()
    if not seen.several:
        return found.select(*edge)
    checked = found.where("several").join(low, "source").where(F.contains("low", "base")).select("source", "target")
    return found.where("NOT several").select("source", "target").unionByName(checked).distinct().select(*edge)


def entity_models(glossary: DataFrame, nodes: DataFrame, limit: int = MAX_MODELS) -> DataFrame:
    """Edges from an entity (``glossary``: entity, aliases) to symbols and files whose name or file name contains one of
    its aliases, the first ``limit`` by id (0.7).

    The pieces of a name that are as long as some alias are joined with the aliases, so that neither side is
    compared with all of the other. Only the lengths that aliases have go to the driver."""
    alias = glossary.select("entity", F.explode(F.transform("aliases", F.lower)).alias("alias")).where("alias <> ''").distinct()
    lengths = F.array(*(F.lit(r[0]) for r in alias.select(F.length("alias")).distinct().collect())).cast("array<int>")
    c = nodes.where("type IN ('symbol', 'file')").select("id", F.explode(F.array(F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce(F.substring_index("path", "/", -1), F.lit(""))))).alias("low"))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length("low")), lambda n: F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda at: F.substring(F.col("low"), at, n)))))
    hit = c.select("id", F.explode(pieces).alias("alias")).join(alias, "alias").select("entity", "id").distinct()
    hit = hit.withColumn("r", F.row_number().over(W.partitionBy("entity").orderBy("id"))).where(F.col("r") <= limit)
    return hit.select(F.concat(F.lit("domain:"), F.col("entity")).alias("source"), F.col("id").alias("target"), F.lit("models").alias("type"), F.lit(0.7).alias("confidence"))


def endpoints(texts: DataFrame, key: str, project: str, text: str, literal: str = PATH_LITERAL) -> DataFrame:
    """(key, project, endpoint): canonical endpoints that texts name in literals."""
    raw = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(literal), F.lit(1)))).alias("raw")
    return texts.where(F.col(text).isNotNull()).select(key, project, raw).select(key, project, endpoint(F.col("raw")).alias("endpoint")).where("endpoint IS NOT NULL").distinct()


def shared_endpoints(found: DataFrame, project: str) -> DataFrame:
    """(endpoint, projects): endpoints of at least two projects."""
    return found.where(F.col(project).isNotNull()).groupBy("endpoint").agg(F.array_sort(F.collect_set(project)).alias("projects")).where(F.size("projects") >= 2)


def endpoint_links(found: DataFrame, key: str, project: str) -> DataFrame:
    """Edges for endpoints of several projects: from each text to the endpoint (0.7). Texts of two projects are linked
    by way of the endpoint they share, not pair by pair."""
    shared = shared_endpoints(found, project).select("endpoint")
    return found.where(F.col(project).isNotNull()).join(shared, "endpoint", "left_semi").select(F.col(key).cast("string").alias("source"), F.concat(F.lit("endpoint:"), F.col("endpoint")).alias("target"), F.lit("references").alias("type"), F.lit(0.7).alias("confidence")).distinct()


def project_links(found: DataFrame, project: str) -> DataFrame:
    """(project_a, project_b, shared): how many endpoints two projects share."""
    p = shared_endpoints(found, project)
    pairs = F.flatten(F.transform("projects", lambda a, i: F.transform(F.slice("projects", i + 2, F.size("projects")), lambda b: F.struct(a.alias("project_a"), b.alias("project_b")))))
    return p.select(F.explode(pairs).alias("x")).groupBy("x.project_a", "x.project_b").agg(F.count("*").alias("shared"))


def summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, summary): a sentence for each file from its role, what it defines and what it depends on, and for each symbol
    from its kind, methods and file; at most 200 characters."""
    named = nodes.select(F.col("id").alias("target"), F.coalesce("name", "id").alias("name"))
    out = edges.where("type IN ('defines', 'depends_on')").join(named, "target").groupBy(F.col("source").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "defines", F.col("name")))).alias("defines"), F.array_sort(F.collect_set(F.when(F.col("type") == "depends_on", F.col("name")))).alias("deps"))
    j = nodes.where("type IN ('file', 'symbol')").join(out, "id", "left")
    n = F.coalesce(F.size("defines"), F.lit(0))
    sample = lambda c: F.array_join(F.slice(c, 1, 6), ", ")
    what = F.when(n > 0, F.concat(F.lit(" Defines "), n.cast("string"), F.lit(": "), sample("defines"), F.when(n > 6, F.concat(F.lit(" (+"), (n - 6).cast("string"), F.lit(")"))).otherwise(""), F.lit("."))).otherwise("")
    uses = F.when(F.coalesce(F.size("deps"), F.lit(0)) > 0, F.concat(F.lit(" Uses "), sample("deps"), F.lit("."))).otherwise("")
    file = F.concat(role(F.col("path")), F.lit("."), what, uses)
    kind = F.coalesce(*(F.when(F.array_contains("tags", k), v) for k, v in (("class", "class"), ("method", "method"), ("function", "function"), ("func", "function"), ("type", "type"), ("var", "constant"))), F.lit("symbol"))
    symbol = F.concat(kind, F.lit(" "), F.coalesce("name", F.lit("")), F.when((kind == "class") & (n > 0), F.concat(F.lit(" with "), n.cast("string"), F.lit(" methods"))).otherwise(""), F.lit("; in "), F.coalesce(F.substring_index("path", "/", -1), F.lit("")), F.lit(" ("), role(F.col("path")), F.lit(").")) 
    return j.select("id", F.substring(F.when(F.col("type") == "file", file).otherwise(symbol), 1, 200).alias("summary"))


def keep_documents(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes without those that came from documents which are gone (``seen``: path)."""
    from_docs = F.col("type").isin("doc", "decision", "convention")
    return nodes.where(~from_docs).unionByName(nodes.where(from_docs).join(seen.select("path").distinct(), "path", "left_semi").select(*nodes.columns))
