"""Orphan references against brute force."""

import random
from datetime import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from weft.operators import references as ref

EDGES = "source string, target string, type string, observed_at timestamp, id string, h long"
NODES = "id string, updated_at timestamp, source string"
REMOVED = "node_id string, removed_at timestamp"


def frames(spark, edges, nodes, removed):
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(removed, REMOVED)


def brute(edges, nodes, removed):
    ids = {n[0] for n in nodes if n[0]}
    live = set()
    for i in ids:
        w = max((n[1] for n in nodes if n[0] == i and n[1]), default=None)
        gone = [r[1] for r in removed if r[0] == i]
        r = max((x for x in gone if x), default=None)
        if not gone or (w is not None and (r is None or w > r)):
            live.add(i)
    return sorted((e[0], e[1], e[2], e[0] not in live, e[1] not in live) for e in edges if e[0] is not None and e[1] is not None and (e[0] not in live or e[1] not in live))


def test_cases(spark):
    t = [dt(2025, 1, k) for k in range(1, 9)]
    edges = [("a", "b", "x", t[1], "c", 1), ("a", "b", "x", t[1], "c", 1), ("a", "gone", "x", t[1], None, None), ("back", "a", "x", None, None, None), (None, "gone", "x", t[2], None, None), ("A", "a", None, t[3], None, None), ("", "a", "x", t[3], None, None), ("notime", "a", "x", t[3], None, None), ("untimed", "a", "x", t[3], None, None)]
    nodes = [("a", t[1], "q"), ("b", None, "q"), ("gone", t[1], None), ("back", t[1], None), ("back", t[5], None), (None, t[1], None), ("notime", None, None), ("untimed", t[1], None)]
    removed = [("gone", t[2]), ("gone", t[2]), ("back", t[3]), ("notime", t[1]), (None, t[1]), ("untimed", None)]
    out = ref.orphan_edges(*frames(spark, edges, nodes, removed))
    assert sorted([tuple(r) for r in out.select("source", "target", "type", "source_missing", "target_missing").collect()], key=str) == sorted(brute(edges, nodes, removed), key=str)
    assert set(EDGES.replace(",", "").split()[::2]) <= set(out.columns)
    report = {(r.type, str(r.month)): (r.n_rows, r.n_keys, r.n_missing_sources, r.n_missing_targets) for r in ref.orphan_report(out).collect()}
    assert report[("x", "2025-01-01")] == (3, 3, 2, 1)


def test_empty(spark):
    assert ref.orphan_edges(*frames(spark, [], [], [])).count() == 0
    assert ref.orphan_edges(*frames(spark, [("a", "b", "x", None, None, None)], [], [])).count() == 1


def test_random_with_a_hot_target(spark):
    rng = random.Random(5)
    ids = [f"node-{i}" for i in range(300)]
    edges = [(rng.choice(ids), "hot" if rng.random() < 0.4 else rng.choice(ids), rng.choice("xy"), dt(2025, 1, 1), None, None) for _ in range(3000)]
    nodes = [(i, dt(2025, 1, rng.randint(1, 28)), None) for i in ids if rng.random() < 0.8]
    removed = [(i, dt(2025, 1, rng.randint(1, 28))) for i in ids if rng.random() < 0.2]
    out = ref.orphan_edges(*frames(spark, edges, nodes, removed)).select("source", "target", "type", "source_missing", "target_missing")
    assert sorted(tuple(r) for r in out.collect()) == brute(edges, nodes, removed)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=6), max_size=30), st.lists(st.text(max_size=6), max_size=30))
def test_binary_search(parents, refs):
    """The probe of one range, with hashes that collide on purpose."""
    import numpy as np
    import pyarrow as pa

    h = lambda s: len(s) % 3
    parents = sorted(set(parents), key=h)
    keys, names = np.array([h(p) for p in parents], np.int64), pa.array(parents, pa.string())
    part = pa.record_batch({"id": pa.array(refs, pa.string()), "h": pa.array([h(r) for r in refs], pa.int64())})
    assert ref._missing(part, keys, names).tolist() == [r not in parents for r in refs]
