"""The property graph as tables: schemas, current rows, and writing rows so that the last writer wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NODES = "id string, type string, name string, project string, path string, span_start int, span_end int, summary string, signature string, tags array<string>, content_hash string, updated_at timestamp"
EDGES = "source string, target string, type string, confidence double, provenance string"
FILES = "path string, project string, content_hash string, indexed_at timestamp"

# The types of nodes and edges.
NODE_TYPES = ("file", "symbol", "module", "decision", "convention", "entity", "external", "doc")
STRUCTURAL = ("calls", "imports", "depends_on", "references")
EXTRACTED_TYPES = ("calls", "imports", "defines", "depends_on", "implements", "decided_because", "governs")
INFERRED_TYPES = ("co_changes_with", "tested_by", "models", "references", "relates_to")
# Words in a provenance that decide the label, and the confidence below which a deduced edge is doubtful.
DOUBTFUL_PROVENANCE = ("heuristic", "guess", "ambiguous", "fuzzy")
OBSERVED_PROVENANCE = ("coverage",)
WEAK = 0.4


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order`` (nulls first), with partial aggregates instead of a window. Maps have no
    order of their own and are compared by their sorted entries."""
    maps = {c for c in rows.columns if rows.schema[c].dataType.typeName() == "map"}
    if maps & {*keys, *order}:
        raise ValueError("a map is no key")
    rest = [c for c in rows.columns if c not in keys and c not in order]
    held = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rest]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *held)).alias("__last"))
    return last.select(*(F.col(c) if c in keys else F.map_from_entries(f"__last.{c}").alias(c) if c in maps else F.col(f"__last.{c}").alias(c) for c in rows.columns))


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The row of each id with the latest updated_at; null ids are left out."""
    return last_of(nodes.where("id IS NOT NULL"), ["id"], ["updated_at"])


def current_edges(edges: DataFrame) -> DataFrame:
    """The latest row of each (source, target, type); rows with a null among these are left out."""
    return last_of(edges.where("source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL"), ["source", "target", "type"], ["observed_at", "confidence", "provenance"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key: a new row replaces all columns of an old one. Of several new rows
    of one key, the one with the greatest values is taken."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)), allowMissingColumns=True)
    return last_of(both, keys, ["__n"]).drop("__n")


def merge_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Facts of two sources by key: every key of either, every column of either, null where neither knows."""
    return left.join(right, key, "full_outer")


def delete_by(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which none of ``columns`` is among the ids of ``gone`` (its first column)."""
    for c in columns:
        g = gone.select(F.col(gone.columns[0]).alias("__g")).distinct()
        rows = rows.join(g, F.col(c) == F.col("__g"), "left_anti")
    return rows


def keep_by(rows: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which each of ``columns`` is among the ids of ``kept`` (its first column)."""
    for c in columns:
        k = kept.select(F.col(kept.columns[0]).alias("__k")).distinct()
        rows = rows.join(k, F.col(c) == F.col("__k"), "left_semi")
    return rows


def confidence_label(kind: Column, provenance: Column, confidence: Column) -> Column:
    """EXTRACTED, INFERRED or AMBIGUOUS, from what an edge is, where it comes from and how sure it is."""
    prov = F.lower(F.coalesce(provenance, F.lit("")))
    doubtful = F.lit(False)
    for w in DOUBTFUL_PROVENANCE:
        doubtful |= prov.contains(w)
    observed = F.lit(False)
    for w in OBSERVED_PROVENANCE:
        observed |= prov.contains(w)
    weak = F.coalesce(confidence, F.lit(1.0)) < WEAK
    return (F.when(doubtful, "AMBIGUOUS").when(observed, "EXTRACTED").when(kind.isin(*INFERRED_TYPES), F.when(weak, "AMBIGUOUS").otherwise("INFERRED"))
            .when(kind.isin(*EXTRACTED_TYPES), "EXTRACTED").otherwise("INFERRED"))
