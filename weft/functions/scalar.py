"""Expressions on single values: hashes, names, endpoints, sentences, roles and budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Folder and file-name words and the role they give, in this order.
ROLES = (
    ("controllers", "HTTP controller"), ("controller", "HTTP controller"), ("routes", "HTTP routes"), ("route", "HTTP routes"),
    ("models", "data model"), ("model", "data model"), ("services", "service logic"), ("service", "service logic"), ("middleware", "HTTP middleware"),
    ("components", "user-interface component"), ("component", "user-interface component"), ("hooks", "user-interface hook"), ("contexts", "shared state"),
    ("types", "types and interfaces"), ("type", "types and interfaces"), ("config", "configuration"), ("api", "API layer"), ("db", "database access"),
    ("repository", "data repository"), ("cli", "command line"), ("test", "tests"), ("scripts", "maintenance script"), ("modules", "logic module"), ("core", "core of the domain"),
)
# Endings of addresses that are no endpoints.
STATIC_ENDINGS = (".css", ".js", ".png", ".svg", ".ico", ".map", ".jpg", ".woff", ".woff2")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def location(path: Column, line: Column) -> Column:
    """path:line, or the path alone."""
    return F.concat_ws(":", path, line.cast("string"))


def plain_lines(text: Column) -> Column:
    """The text without terminal colour codes."""
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[a-zA-Z]", "")


def camel_spaced(text: Column) -> Column:
    """Spaces between the words of camel-case names."""
    return F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before a space, at most 200 characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    hit = F.regexp_extract(flat, r"^(.+?[.!?])(\s|$)", 1)
    return F.substring(F.when(hit != "", hit).otherwise(flat), 1, 200)


def slug(text: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    return F.when(s == "", "sec").otherwise(s)


def clean_route(path: Column) -> Column:
    """Parameters as :p, without slashes at the end."""
    p = F.regexp_replace(path, r":[A-Za-z_]\w*", ":p")
    p = F.regexp_replace(F.regexp_replace(p, r"\$\{[^}]+\}", ":p"), r"\{[^}]+\}", ":p")
    return F.regexp_replace(p, "/+$", "")


def endpoint(raw: Column) -> Column:
    """The canonical endpoint of a path literal or address, or null: addresses without a path give their host, static
    files none, and a relative path needs two segments."""
    url = raw.rlike("^https?://")
    host = F.regexp_extract(raw, "^https?://([^/?#]*)", 1)
    path = clean_route(F.when(url, F.regexp_extract(raw, "^https?://[^/?#]*([^?#]*)", 1)).otherwise(raw))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    static = F.lit(False)
    for e in STATIC_ENDINGS:
        static |= path.endswith(e)
    joined = F.concat(F.lit("/"), F.array_join(segments, "/"))
    bare = F.when(host != "", F.concat(F.lit("host:"), host))
    return F.when(url & (F.size(segments) == 0), bare).when(static, None).when(url | (F.size(segments) >= 2), joined)


def role(path: Column) -> Column:
    """What a path's folders and name say of its role; the first word of ``ROLES`` that occurs decides."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    out = F.when(path.isNull() | (path == ""), "component")
    for word, name in ROLES:
        out = out.when(low.contains(f"/{word}/") | low.endswith(f"/{word}") | base.contains(word), name)
    return out.otherwise("source file")


def module_key(path: Column) -> Column:
    """The dotted module of a Python path, without a closing __init__."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/", ".")
