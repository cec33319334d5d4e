"""Most similar vectors for every vector: cross-polytope hashing with fast Hadamard pseudo-rotations.

Each of ``TABLES`` tables turns a unit vector ``TURNS`` times by three rounds of random signs and a Hadamard transform; the
nearest signed axis of each turn, then the second nearest of each, are the levels of its code. A bucket is as many levels
as it takes until at most ``BUCKET`` vectors share them, so that the number of axes grows with the logarithm of the number
of vectors, and more where they are dense. A vector is indexed under its own code and asks, besides, under the
``PROBES`` - 1 next likely codes. Whatever shares a bucket is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from weft.session import cut

TABLES, PROBES, TURNS, SEED = 6, 2, 4, 20
#: Most vectors in a bucket, and about how many one task compares at a time.
BUCKET, PART_ROWS = 1024, 32_768
#: Vectors, about, from which the bounds of the parts are taken.
SAMPLE_ROWS = 100_000
#: Vectors of one code with a cosine this near to 1 all have 1.000000 with each other.
SAME = 1 - 1e-7


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def _codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> Iterator[np.ndarray]:
    """For each table the codes of each vector: its own, then those where one of the first turns takes its second axis
    instead, by the length that is lost. A level is eight bits or more, the first level the highest."""
    dim = unit.shape[1]
    padded = 1 << max(1, (dim - 1).bit_length())
    bits = max(1, (2 * padded - 1).bit_length())
    levels = min(2 * TURNS, 62 // bits)
    turns = min(TURNS, levels)
    x = np.zeros((len(unit), padded))
    x[:, :dim] = unit
    draw = np.random.default_rng(seed)
    rows = np.arange(len(x))
    for _ in range(tables):
        best, lost = [], []
        for _ in range(turns):
            y = x
            for signs in draw.choice([-1.0, 1.0], (3, padded)):
                y = _hadamard(y * signs)
            size = np.abs(y)
            first = size.argmax(1)
            a = size[rows, first]
            size[rows, first] = -1
            second = size.argmax(1)
            best.append([2 * i + (y[rows, i] < 0) for i in (first, second)])
            lost.append((a - size[rows, second]) ** 2)
        level = np.stack([best[t][0] for t in range(turns)] + [best[t][1] for t in range(levels - turns)], 1)
        shift = bits * (levels - 1 - np.arange(levels))
        own = (level << shift).sum(1)
        # The buckets of the first two turns split nearly everything; what is asked for lies there.
        order = np.argsort(np.stack(lost[:2], 1), axis=1, kind="stable")[:, :probes - 1]
        out = [own]
        for k in range(order.shape[1]):
            t = order[:, k]
            other = np.stack([b[1] for b in best], 1)[rows, t]
            out.append(own + ((other - level[rows, t]) << shift[t]))
        yield np.stack(out, 1)


def usable_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vector): vectors of ``dim`` numbers that are not all zero, one a key (the least, if a key has several).

    Null keys and vectors, null or NaN or infinite numbers and wrong sizes are left out."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).groupBy(F.col(key).alias("id")).agg(F.min(v).alias("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class _Part:
    """What one table has in one range of codes."""

    def __init__(self, dim: int, k: int, least: float, shifts: list[int], bucket: int):
        self.dim, self.k, self.least, self.shifts, self.bucket = dim, k, least, shifts, bucket
        self.ids: list[pa.Array] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_found = 0

    def pairs(self, a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> None:
        self.found.append((a, b, sims))
        self.n_found += len(a)

    def compare(self, unit: np.ndarray, index: np.ndarray, asks: np.ndarray) -> None:
        """Everything of a bucket with everything indexed in it, both ways, a stretch at a time."""
        step = max(1, 4_000_000 // max(1, len(index)))
        for who, own in ((index, True), (asks, False)):
            for lo in range(0, len(who), step):
                q = who[lo:lo + step]
                sims = np.round(unit[q] @ unit[index].T, 6)
                i, j = np.nonzero(sims >= self.least)
                i, j, s = q[i], index[j], sims[i, j]
                self.pairs(i, j, s)
                if not own:
                    self.pairs(j, i, s)
                if self.n_found > 3_000_000:
                    self.best()

    def best(self) -> None:
        """Keep the k best of each row so far; ties by the order of ids."""
        a, b, s = (np.concatenate([f[c] for f in self.found]) for c in range(3))
        keep = self.rank[a] != self.rank[b]
        a, b, s = a[keep], b[keep], s[keep]
        order = np.lexsort((self.rank[b], -s, self.rank[a]))
        a, b, s = a[order], b[order], s[order]
        ra, rb = self.rank[a], self.rank[b]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]) | (s[1:] != s[:-1])
        a, b, s, ra = a[fresh], b[fresh], s[fresh], ra[fresh]
        nth = np.arange(len(a)) - np.searchsorted(ra, ra, "left")
        keep = nth < self.k
        self.found, self.n_found = [(a[keep], b[keep], s[keep])], int(keep.sum())

    def same(self, unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows of one code without those that have the direction of another: these get the smallest ids of that direction,
        as the rule for ties demands. What is left stands for them."""
        left, rest = [], rows[np.argsort(self.rank[rows], kind="stable")]
        while len(rest):
            near = unit[rest] @ unit[rest[0]] >= SAME
            near[0] = True
            group, rest = rest[near], rest[~near]
            heads = group[:self.k + 1]
            a, b = np.repeat(group, len(heads)), np.tile(heads, len(group))
            self.pairs(a, b, np.ones(len(a)))
            left.append(heads)
            if len(left) > 1000:
                left.append(rest)
                break
        return np.concatenate(left)

    def run(self, code: np.ndarray, role: np.ndarray, ids: pa.Array, unit: np.ndarray) -> pa.RecordBatch | None:
        names = ids.dictionary_encode()
        rank = np.empty(len(names.dictionary), np.int64)
        rank[pa.compute.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank))
        self.rank = rank[names.indices.to_numpy()]
        index, asks = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        index, asks = index[np.argsort(code[index], kind="stable")], asks[np.argsort(code[asks], kind="stable")]
        todo = [(index, asks, 0)]
        while todo:
            index, asks, level = todo.pop()
            if not len(index):
                continue
            if len(index) <= self.bucket or level == len(self.shifts):
                self.compare(unit, self.same(unit, index) if len(index) > self.bucket else index, asks)
                continue
            key, ask = code[index] >> self.shifts[level], code[asks] >> self.shifts[level]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                a, z = np.searchsorted(ask, key[lo], "left"), np.searchsorted(ask, key[lo], "right")
                todo.append((index[lo:hi], asks[a:z], level + 1))
        if not self.n_found:
            return None
        self.best()
        a, b, s = self.found[0]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s)], ["id", "other", "sim"])


def _compare(dim: int, k: int, least: float, shifts: list[int], bucket: int, number: type):
    """Rows come sorted by part: what is indexed (and asks as well), and what only asks. Whatever meets counts for both, so
    that a pair is missed only if neither asks in a bucket of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                unit = _unit(np.frombuffer(b"".join(t["vector"].to_pylist()), number).reshape(-1, dim).astype(np.float64))
                found = _Part(dim, k, least, shifts, bucket).run(t["code"].to_numpy(), t["role"].to_numpy(), t["id"].combine_chunks(), unit)
                if found is not None and found.num_rows:
                    yield from (found.slice(i, 100_000) for i in range(0, found.num_rows, 100_000))

        for b in batches:
            part = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if lo == hi:
                    continue
                if part[lo] != at:
                    yield from settle()
                    at, held = part[lo], []
                held.append(b.slice(lo, hi - lo))
        yield from settle()

    return run


def _bounds(codes: np.ndarray, parts: int, shifts: list[int]) -> np.ndarray:
    """Where a table is cut into parts: quantiles of the codes, moved down to where a level begins if that moves them by at
    most half a part, the first level that does so. A code that fills several parts is several bounds."""
    codes, out = np.sort(codes), []
    for i in range(1, parts):
        at = i * len(codes) // parts
        for shift in [*shifts, 0]:
            bound = codes[at] >> shift << shift
            if at - np.searchsorted(codes, bound, "left") <= len(codes) / parts / 2:
                break
        out.append(max(bound, out[-1] if out else bound))
    return np.array(out, np.int64)


def _part_of(bounds: np.ndarray, code: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The part of each code; a code that is several bounds is dealt out over as many parts."""
    left, right = np.searchsorted(bounds, code, "left"), np.searchsorted(bounds, code, "right")
    return np.where(right - left > 1, left + 1 + h % np.maximum(right - left, 1), right)


def nearest(rows: DataFrame, key: str, vector: str, dim: int, k: int = 5, least: float = 0.9, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(id, other, sim): for every vector the ``k`` most similar others with a cosine of at least ``least``.

    Cosines are in double precision, rounded to 6 decimals; ties go to the smaller id. Equal vectors are searched
    once: a class of equal vectors is one row of the index, stands for its k + 1 smallest ids, and gives its result
    to all its members, so that a third of all rows with one vector costs no more than one.

    Each table is cut into ranges of codes of about ``PART_ROWS`` vectors; their bounds are quantiles of the codes of
    about ``SAMPLE_ROWS`` vectors, and nothing else goes by way of the driver. A bucket has no cap: it is split by further
    levels of the code, vectors of one direction are given the smallest ids of it, and what then is left under one whole
    code is compared as it is. A code that fills several parts is dealt out over them by a hash of the id, so that no task holds
    it alone; its vectors, which have one direction, then get the smallest ids of their part. Vectors are shuffled once,
    ``tables`` * ``probes`` times each, as bare numbers.
    What the tables miss is missing; what they find is exact. See :func:`usable_vectors` for what takes part."""
    given = usable_vectors(rows, key, vector, dim)
    reps = cut(given.groupBy("vector").agg(F.min("id").alias("id")))
    members = given.join(reps.select("vector", F.col("id").alias("rep")), "vector").select("id", "rep")
    own = W.partitionBy("rep").orderBy("id")
    smallest = members.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("other"))
    padded = 1 << max(1, (dim - 1).bit_length())
    bits = max(1, (2 * padded - 1).bit_length())
    levels = min(2 * TURNS, 62 // bits)
    shifts = [bits * (levels - 1 - i) for i in range(levels)]

    number = np.float32 if reps.schema["vector"].dataType.elementType.typeName() == "float" else np.float64
    total = reps.count()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for t, codes in enumerate(_codes(_unit(_matrix(b.column(0), dim)), tables, 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t), pa.int32()), pa.array(codes[:, 0], pa.int64())], ["t", "code"])

    parts = max(1, -(-total // PART_ROWS))
    bounds = [np.empty(0, np.int64)] * tables
    if parts > 1:
        some = reps.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(-(-total // SAMPLE_ROWS))) == 0).select("vector").mapInArrow(sample, "t int, code bigint").toArrow()
        of, codes = some["t"].to_numpy(), some["code"].to_numpy()
        seen = [codes[of == t] for t in range(tables)]
        bounds = [_bounds(c, parts, shifts) for c in seen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                m, mine = _matrix(part.column("vector"), dim), part.column("h").to_numpy()
                body, size = m.astype(number).tobytes(), number().itemsize * dim
                packed = pa.array([body[i:i + size] for i in range(0, len(body), size)], pa.binary())
                for t, codes in enumerate(_codes(_unit(m), tables, probes)):
                    n, p = codes.shape
                    code, take = codes.T.ravel(), pa.array(np.tile(np.arange(n), p))
                    where = _part_of(bounds[t], code, np.tile(mine, p)) + t * parts
                    yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(code, pa.int64()), pa.array(np.repeat(np.minimum(np.arange(p), 1), n), pa.int32()), part.column("id").take(take), packed.take(take)], ["part", "code", "role", "id", "vector"])

    placed = reps.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h")).mapInArrow(place, "part bigint, code bigint, role int, id string, vector binary")
    laid = placed.repartition("part").sortWithinPartitions("part")
    met = laid.mapInArrow(_compare(dim, k, least, shifts, BUCKET, number), "id string, other string, sim double").groupBy("id", "other").agg(F.max("sim").alias("sim"))
    best = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    met = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    stand_in = smallest.select(F.col("rep").alias("__c"), F.col("other").alias("__o"))
    found = met.join(stand_in, F.col("other") == F.col("__c")).select(F.col("id").alias("rep"), F.col("__o").alias("other"), "sim")
    found = found.unionByName(smallest.withColumn("sim", F.lit(1.0)))
    ranked = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "other"))).alias("list"))
    each = members.join(ranked, "rep").select("id", F.explode(F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return each.select("id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("sim"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """(node_a, node_b, sim): each pair once, the smaller id first."""
    return found.groupBy(F.least("id", "other").alias("node_a"), F.greatest("id", "other").alias("node_b")).agg(F.max("sim").alias("sim"))
