"""The settings of projects that imports are resolved by: path aliases, Go modules and PHP namespaces."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "project string, prefix string, base string"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)


def relaxed_json(text: str) -> dict:
    """JSON with comments and commas before closing brackets; an empty object if it cannot be read."""
    plain = _TOKEN.sub(lambda m: m.group() if m.group().startswith('"') else "", text)
    try:
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def of_file(project: str, name: str, text: str) -> Iterable[tuple[str, str, str]]:
    """(project, prefix, base) from tsconfig.json, jsconfig.json, go.mod or composer.json."""
    if name in ("tsconfig.json", "jsconfig.json"):
        options = relaxed_json(text).get("compilerOptions") or {}
        for pattern, targets in (options.get("paths") or {}).items():
            for t in targets if isinstance(targets, list) else []:
                base = posixpath.normpath(posixpath.join(options.get("baseUrl") or ".", t.split("*", 1)[0]))
                yield project, pattern.split("*", 1)[0], "" if base == "." else base
    elif name == "go.mod":
        for m in re.finditer(r"(?m)^\s*module\s+(\S+)", text):
            yield project, m.group(1) + "/", ""
            break
    elif name == "composer.json":
        for part in ("autoload", "autoload-dev"):
            for prefix, base in ((relaxed_json(text).get(part) or {}).get("psr-4") or {}).items():
                yield project, prefix.strip("\\") + "\\", str((base[0] if isinstance(base, list) and base else base) or "").strip("/")


def settings(spark: SparkSession, files: Iterable[tuple[str, str, str]]) -> DataFrame:
    """The settings of (project, file name, text), one small table."""
    return spark.createDataFrame([row for f in files for row in of_file(*f)], SCHEMA)
