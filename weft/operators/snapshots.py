"""Comparing states of a listing, and waiting until changes come to rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): 'added', 'removed' or 'changed' between two listings with one row a key; a null version equals
    a null version."""
    b = before.select(F.col(key), F.col(version).alias("__b"), F.lit(1).alias("__hb"))
    a = after.select(F.col(key), F.col(version).alias("__a"), F.lit(1).alias("__ha"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("__hb").isNull(), "added").when(F.col("__ha").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")


def debounced(events: DataFrame, group: list[str], ts: str, gap: str) -> DataFrame:
    """(group, first_event, last_event, n): bursts of events, each ended by a pause of at least ``gap``. Works on streams
    as well, where the caller sets the watermark."""
    w = events.where(F.col(ts).isNotNull()).groupBy(*group, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), F.count("*").alias("n"))
    return w.select(*group, "first_event", "last_event", "n")
