"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Parents that one range holds on average; the sorted array of one range is all that a task keeps.
RANGE_ROWS = 100_000


def live_ids(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """(id): ids with a row in ``nodes`` that, where ``removed`` names them, were written after their latest removal.

    A null updated_at or removed_at counts as earliest, so that a removed id without times is not live. Null ids are
    left out; repeated rows are one."""
    written = nodes.where("id IS NOT NULL").groupBy("id").agg(F.max("updated_at").alias("w"))
    gone = removed.where("node_id IS NOT NULL").groupBy("node_id").agg(F.max("removed_at").alias("r"))
    both = written.join(gone, F.col("id") == F.col("node_id"), "left")
    return both.where("node_id IS NULL OR coalesce(w > r, w IS NOT NULL)").select("id")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, is_ref, h): the parents of a range, then what refers to it."""
    at, keys, names, parts = None, np.empty(0, np.int64), None, []
    for batch in batches:
        ranges = batch.column("rng").to_numpy(zero_copy_only=False)
        ref = batch.column("is_ref").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(ranges) != 0) | (np.diff(ref) != 0)) + 1
        misses = []
        for lo, hi in zip([0, *cuts], [*cuts, len(ranges)]):
            if lo == hi:
                continue
            if ranges[lo] != at:
                at, parts, keys, names = ranges[lo], [], np.empty(0, np.int64), None
            part = batch.slice(lo, hi - lo)
            if not ref[lo]:
                parts.append(part)
                continue
            if parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                keys, names, parts = table.column("h").to_numpy(), table.column("id").combine_chunks(), []
            misses.append(part.filter(pa.array(_missing(part, keys, names))))
        for m in misses:
            if m.num_rows:
                yield pa.RecordBatch.from_arrays([m.column("id")], ["id"])


def _missing(part: pa.RecordBatch, keys: np.ndarray, names: pa.Array | None) -> np.ndarray:
    """Binary search of a batch in the sorted array; ids with the same hash are compared as written."""
    missing = np.ones(part.num_rows, bool)
    if names is None or not len(keys):
        return missing
    h, ids = part.column("h").to_numpy(), part.column("id")
    left, right = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
    for step in range(int((right - left).max(initial=0))):
        rows = np.flatnonzero(missing & (left + step < right))
        same = pc.equal(ids.take(pa.array(rows)), names.take(pa.array(left[rows] + step))).to_numpy(zero_copy_only=False)
        missing[rows[same]] = False
    return missing


def missing_ids(refs: DataFrame, parents: DataFrame, parent_rows: int) -> DataFrame:
    """(id): the distinct ids of ``refs`` that are not in ``parents`` (both one column ``id``, parents distinct).

    Both sides are laid out by ranges of a 64-bit hash of the id, which are even whatever the ids are. References
    are first made distinct, combined before the shuffle, so a hot parent is one probe. In each range the parents
    are one sorted array, and batches of references are probed by binary search; equal hashes are compared as
    strings. ``parent_rows`` (any upper estimate) sets the number of ranges, so that memory does not grow with data.

    Null ids are no references. Empty parents make every reference missing."""
    bits = max(4, min(40, int(np.ceil(np.log2(max(1, parent_rows) / RANGE_ROWS + 1)))))
    one = lambda df, flag: df.select("id", F.lit(flag).alias("is_ref"))
    both = one(parents, False).unionByName(one(refs.where("id IS NOT NULL").distinct(), True))
    both = both.withColumn("h", F.xxhash64("id")).withColumn("rng", F.shiftrightunsigned("h", 64 - bits))
    laid = both.repartition("rng").sortWithinPartitions("rng", "is_ref", "h")
    return laid.mapInArrow(_probe, "id string")


def orphan_edges(edges: DataFrame, nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of ``edges`` with both endpoints non-null of which at least one is not live, plus the booleans
    source_missing and target_missing.

    Rows are kept as often as they occur. Ids compare exactly as written. Extra columns of the inputs are kept
    (edges) or ignored (nodes, removed)."""
    whole = edges.where("source IS NOT NULL AND target IS NOT NULL")
    refs = whole.select(F.col("source").alias("id")).unionByName(whole.select(F.col("target").alias("id")))
    dead = missing_ids(refs, live_ids(nodes, removed), nodes.count())
    s, t = dead.select(F.col("id").alias("__s")), dead.select(F.col("id").alias("__t"))
    out = whole.join(s, F.col("source") == F.col("__s"), "left").join(t, F.col("target") == F.col("__t"), "left")
    out = out.where("__s IS NOT NULL OR __t IS NOT NULL")
    return out.withColumn("source_missing", F.col("__s").isNotNull()).withColumn("target_missing", F.col("__t").isNotNull()).drop("__s", "__t")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per edge type and month of observed_at: rows, distinct keys, missing sources and targets.

    A null type or time is a group of its own."""
    month = F.trunc(F.to_date("observed_at"), "month").alias("month")
    each = orphans.groupBy("type", month, "source", "target").agg(F.count("*").alias("rows"), F.max(F.col("source_missing").cast("int")).alias("s"), F.max(F.col("target_missing").cast("int")).alias("t"))
    return each.groupBy("type", "month").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_keys"), F.sum("s").cast("bigint").alias("n_missing_sources"), F.sum("t").cast("bigint").alias("n_missing_targets"))
