"""Evaluation texts in training text: a positional inverted index in segments, searched for phrases."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.session import cut

#: Words in one segment of the index, about; a segment is what a worker holds at a time.
SEGMENT_WORDS = 2_000_000
#: Items, and words of items, that one pass over the index looks for.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000

_WORD = re.compile(r"[^\W_]+")
_INDEX = "doc_ids array<bigint>, doc_starts array<bigint>, terms array<string>, offsets binary, positions binary"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, without format characters, regardless of case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) != "Cf")
        text = unicodedata.normalize("NFKC", text.casefold())
        return _WORD.findall(text)
    return _WORD.findall(text.lower())


def build_index(docs: DataFrame, key: str, text: str, store: bool = True) -> DataFrame:
    """Segments of a positional inverted index over whole texts: the documents of a segment with their first
    position, its terms, and for each term the ordered positions (int32) at its offset (int64).

    Documents are laid out one behind the other with a gap, so that no phrase crosses them. The index does not
    depend on what is searched. It is stored in the shared folder, so that every block of items and every search
    reads postings and not texts; with ``store=False`` it is only a plan. Null and empty texts have no
    postings. ``key`` must be integral. A text of any length is one document of one segment."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            d = defaultdict()
            d.default_factory = d.__len__
            return d, [], [], []

        def segment():
            at = np.repeat(np.asarray(starts), [len(p) for p in parts]) + np.concatenate([np.arange(len(p)) for p in parts])
            term = np.concatenate(parts)
            order = np.argsort(term, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(ids)))]).astype(np.int64)
            columns = [[doc_ids], [starts], [list(ids)], [offsets.tobytes()], [at[order].astype(np.int32).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        names = ["doc_ids", "doc_starts", "terms", "offsets", "positions"]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()]
        (ids, doc_ids, starts, parts), size = fresh(), 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = words(t)
                if not found or doc is None:
                    continue
                doc_ids.append(doc), starts.append(size), parts.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                size += len(found) + 1
                if size >= SEGMENT_WORDS:
                    yield segment()
                    (ids, doc_ids, starts, parts), size = fresh(), 0
        if parts:
            yield segment()

    index = docs.select(F.col(key).cast("bigint"), text).mapInArrow(build, _INDEX)
    return cut(index) if store else index


class Segment:
    """One segment, as it is searched."""

    def __init__(self, row: dict):
        self.doc_ids, self.starts = np.asarray(row["doc_ids"]), np.asarray(row["doc_starts"])
        self.ids = {t: i for i, t in enumerate(row["terms"])}
        self.offsets, self.positions = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["positions"], np.int32)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.offsets[term]:self.offsets[term + 1]]

    def phrase(self, terms: np.ndarray) -> tuple[np.ndarray, int]:
        """Where the terms stand one behind the other: the offset-adjusted lists intersected from the rarest on. If they do
        nowhere, also the first of the terms that were looked at by then: no window with these holds either."""
        by_count = np.argsort(self.offsets[terms + 1] - self.offsets[terms], kind="stable")
        found = self.postings(terms[by_count[0]]) - by_count[0]
        for n, k in enumerate(by_count[1:], 1):
            other = self.postings(terms[k])
            at = np.searchsorted(other, found + k)
            found = found[other[np.minimum(at, len(other) - 1)] == found + k]
            if not len(found):
                return found, int(by_count[:n + 1].min())
        return found, 0

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Where the rarest term stands with every other term at most ``span`` words away in the same document."""
        terms = np.unique(terms)
        terms = terms[np.argsort(self.offsets[terms + 1] - self.offsets[terms], kind="stable")]
        found = self.postings(terms[0])
        home = self.docs(found)
        for t in terms[1:]:
            if not len(found):
                break
            other = self.postings(t)
            at = np.searchsorted(other, found)
            ok = np.zeros(len(found), bool)
            for near in (np.minimum(at, len(other) - 1), np.maximum(at - 1, 0)):
                ok |= (np.abs(other[near] - found) <= span) & (self.docs(other[near]) == home)
            found, home = found[ok], home[ok]
        return found

    def docs(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with their words, for some at a time; the texts are taken apart in the workers."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])

    block, size = [], 0
    given = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in given.mapInArrow(split, "item_id bigint, words array<string>").toLocalIterator():
        if row[1]:
            block.append((row[0], row[1]))
            size += len(row[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def save_index(index: DataFrame, folder: str, version: str) -> str:
    """Keep an index beyond the application, as a new version beside older ones; the folder it lies in."""
    path = f"{folder.rstrip('/')}/index-{version}"
    index.write.mode("errorifexists").parquet(path)
    return path


def search(index: DataFrame, items: DataFrame, key: str, text: str, length: int = 12, near: int | None = None) -> DataFrame:
    """(item_id, doc_id, kind, n_windows): documents that hold ``length`` consecutive words of an item, or all of its
    words in sequence if it has fewer (kind 'phrase'); with ``near`` also those where all words of such a window
    stand within ``near`` words of its rarest word, in any order (kind 'near').

    The items are a stated query set: ``BLOCK_ITEMS`` of them or ``BLOCK_WORDS`` words at a time are sent to the workers, and
    every block is searched in the whole index. Items without words match nothing. n_windows counts the windows of the item found in
    the document. Repeated items and documents come out once with the greatest count."""

    def job(block: list[tuple[int, list[str]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    seg, hits = Segment(row), defaultdict(int)
                    for item, found in block:
                        ids = np.fromiter((seg.ids.get(w, -1) for w in found), np.int64, len(found))
                        size = min(length, len(found))
                        unknown = np.flatnonzero(ids < 0)
                        i, last = 0, len(found) - size
                        while i <= last:
                            gap = np.searchsorted(unknown, i)
                            if gap < len(unknown) and unknown[gap] < i + size:
                                i = int(unknown[gap]) + 1
                                continue
                            at, first = seg.phrase(ids[i:i + size])
                            for doc in np.unique(seg.docs(at)).tolist() if len(at) else ():
                                hits[item, int(seg.doc_ids[doc]), "phrase"] += 1
                            if near:
                                for doc in np.unique(seg.docs(seg.near(ids[i:i + size], near))).tolist():
                                    hits[item, int(seg.doc_ids[doc]), "near"] += 1
                            i += 1 if len(at) or near else first + 1
                    if hits:
                        keys = list(hits)
                        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys]), pa.array(list(hits.values()), pa.int64())], ["item_id", "doc_id", "kind", "n_windows"])
        return run

    schema = "item_id bigint, doc_id bigint, kind string, n_windows bigint"
    parts = [index.mapInArrow(job(block), schema) for block in _blocks(items, key, text)]
    if not parts:
        return index.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("item_id", "doc_id", "kind").agg(F.max("n_windows").alias("n_windows"))
