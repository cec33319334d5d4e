"""Filling fixed-capacity containers with items: best-fit decreasing over a segment tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.llm import tokens
from weft.session import cut

#: Items packed together. More make the last open containers of a group matter less; one group is one task's work.
GROUP_ITEMS = 65_536
_BIN_BITS = 40


class OpenBins:
    """Open containers by what is left in them; a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _count(self, left: int, by: int) -> None:
        i = self.size + left
        while i:
            self.tree[i] += by
            i >>= 1

    def _tightest(self, need: int) -> int:
        """The least capacity >= need with an open container, or -1."""
        tree, i = self.tree, self.size + need
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def put(self, need: int) -> int:
        """The container that gets an item of this size."""
        left = self._tightest(need)
        if left < 0:
            left, bin_ = self.capacity, self.made
            self.made += 1
        else:
            bin_ = self.bins[left].pop()
            self._count(left, -1)
        self.bins[left - need].append(bin_)
        self._count(left - need, 1)
        return bin_


def token_counts(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens): the tokens of each whole text; null for a null text, 0 for an empty one."""
    path = path or tokens.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [None if t is None else len(tokens.encode(t, path)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_tokens bigint")


def pack(sizes: DataFrame, key: str, size: str, capacity: int, n_rows: int) -> DataFrame:
    """(key, piece, start, size, container): a container for each item, the sizes in each summing to <= capacity.

    An item larger than ``capacity`` is split into full containers and a rest; every other item is whole. Items are
    spread by a hash of the key over groups of about ``GROUP_ITEMS`` (from ``n_rows``, any upper estimate), each
    group is taken in decreasing size, and every item goes to the open container with the least room that holds it.
    What a group leaves at most half full, one container at most, is then put together with that of the other groups.

    A null size gives one row with a null container; a size of 0 takes no room; a negative size is an error of the
    caller and counts as 0. Ties are broken by key, so the result is the same on every run. Repeated rows are
    packed as often as they occur. Extra columns are ignored. No rows give no rows."""
    groups = max(1, -(-n_rows // GROUP_ITEMS))
    need = F.when(F.col(size).isNotNull(), F.greatest(F.col(size).cast("bigint"), F.lit(0)))
    items = sizes.select(F.col(key).alias("key"), need.alias("n"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.greatest(F.col("n"), F.lit(1)) - 1) / capacity).cast("bigint"))
    cutup = items.select("key", F.posexplode(starts).alias("piece", "k"), "n")
    known = F.col("n").isNotNull()
    cutup = cutup.select("key", "piece", F.when(known, F.col("k") * capacity).alias("start"), F.when(known, F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("k") * capacity)).alias("size"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("grp"))
    laid = cutup.repartition("grp").sortWithinPartitions("grp", F.desc("size"), "key", "piece")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins = None, None
        for b in batches:
            out = []
            for group, n in zip(b.column("grp").to_pylist(), b.column("size").to_pylist()):
                if group != at:
                    at, bins = group, OpenBins(capacity)
                out.append(None if n is None else (group << _BIN_BITS) | bins.put(n))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(out, pa.int64())], ["key", "piece", "start", "size", "container"])

    kind = sizes.schema[key].dataType.simpleString()
    done = laid.mapInArrow(fill, f"key {kind}, piece int, start bigint, size bigint, container bigint")
    if groups > 1:
        done = cut(done)
        moved = _merged(done, capacity, groups).select(F.col("container").alias("__from"), F.col("into").alias("__into"))
        done = done.join(moved, F.col("container") == F.col("__from"), "left").select("key", "piece", "start", "size", F.coalesce("__into", "container").alias("container"))
    return done.withColumnRenamed("key", key)


def _merged(done: DataFrame, capacity: int, groups: int) -> DataFrame:
    """(container, into): the containers that are at most half full, of which a group leaves one at most, put together by the
    same rule."""
    half = done.where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("size")).where(F.col("size") * 2 <= capacity)
    many = max(1, -(-groups // GROUP_ITEMS))
    laid = half.withColumn("grp", F.pmod(F.xxhash64("container"), F.lit(many))).repartition("grp").sortWithinPartitions("grp", F.desc("size"), "container")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins, names = None, None, {}
        for b in batches:
            out = []
            for group, n, container in zip(b.column("grp").to_pylist(), b.column("size").to_pylist(), b.column("container").to_pylist()):
                if group != at:
                    at, bins, names = group, OpenBins(capacity), {}
                out.append(names.setdefault(bins.put(n), container))
            yield pa.RecordBatch.from_arrays([b.column("container"), pa.array(out, pa.int64())], ["container", "into"])

    return laid.mapInArrow(fill, "container bigint, into bigint")
