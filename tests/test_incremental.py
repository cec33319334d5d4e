"""Changed records: failures, late rows, nulls, ties and empty inputs."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.operators import asof, incremental as inc

SOURCE = "key string, version string, project string, seen_at timestamp, extra string"
RUNS = "run_id long, project string, status string, started_at timestamp, finished_at timestamp, logged_at timestamp"


def day(n, hour=0):
    return dt(2025, 1, n, hour)


def runs(spark):
    rows = [(1, "a", "success", day(1), day(1, 2), day(1, 2)), (1, "a", "running", day(1), None, day(1)), (2, "a", "failed", day(3), day(3, 2), day(3, 2)),
            (3, "a", "running", day(4), None, day(4)), (4, "a", "success", day(5), day(5, 2), day(5, 2)), (4, "a", "success", day(5), day(5, 2), day(5, 2)), (None, "a", "success", day(9), None, day(9))]
    return spark.createDataFrame(rows, RUNS)


def test_states_and_bound(spark):
    states = inc.run_states(runs(spark))
    assert {(r.run_id, r.status) for r in states.collect()} == {(1, "success"), (2, "failed"), (3, "running"), (4, "success")}
    # run 3 was never closed: it is open at run 4, and the reread goes back to its start
    assert [tuple(r) for r in inc.reread_from(states).collect()] == [("a", day(4))]


def test_only_successful_runs_count(spark):
    written = spark.createDataFrame([("k1", "v1", "a", day(1, 1)), ("k2", "v1", "a", day(3, 1)), ("k3", "v0", "a", day(1, 1)), ("k3", "v1", "a", day(3, 1)), ("k4", "v1", "a", dt(2024, 1, 1)), ("k5", "v1", None, day(5, 1)), (None, "v1", "a", day(5, 1)), ("k6", "v1", "a", dt(2026, 5, 5))],
                                    "key string, version string, project string, written_at timestamp")
    ledger = inc.processed_ledger(written, inc.run_states(runs(spark)))
    assert {tuple(r) for r in ledger.collect()} == {("k1", "v1"), ("k3", "v0"), ("k6", "v1")}


def test_changed_records(spark):
    rows = [("same", "v1", "a", day(1), "x"), ("new", "v1", "a", day(6), "x"), ("changed", "v1", "a", day(1), "x"), ("changed", "v2", "a", day(6), "x"), ("changed", "v2", "a", day(6), "x"), ("back", "v2", "a", day(1), "x"), ("back", "v1", "a", day(6), "x"),
            ("null", None, "a", day(1), "x"), (None, "v", "a", day(1), "x"), ("late", "v1", "a", day(2), "x"), ("tie", "v1", "a", day(6), "x"), ("tie", "v2", "a", day(6), "x"), ("notime", "v1", "a", None, "x")]
    source = spark.createDataFrame(rows, SOURCE)
    ledger = spark.createDataFrame([("same", "v1"), ("changed", "v1"), ("back", "v2"), ("null", None), ("tie", "v2")], "key string, version string")
    bounds = spark.createDataFrame([("a", day(4))], "project string, reread_from timestamp")
    found = {r.key: r.via for r in inc.changed_records(source, ledger, bounds).collect()}
    assert found == {"new": "reread", "changed": "reread", "back": "reread", "null": "late", "late": "late", "notime": "reread"}
    trusted = {r.key for r in inc.changed_records(source, ledger, bounds, late="trust").collect()}
    assert trusted == {"new", "changed", "back", "notime"}
    with pytest.raises(ValueError):
        inc.changed_records(source, ledger, late="maybe")


def test_empty_inputs(spark):
    source, ledger = spark.createDataFrame([], SOURCE), spark.createDataFrame([], "key string, version string")
    assert inc.changed_records(source, ledger).count() == 0
    one = spark.createDataFrame([("k", "v", "a", day(1), "x")], SOURCE)
    assert inc.changed_records(one, ledger).count() == 1


def test_runs_that_fail_skip_and_repeat_nothing(spark):
    """Three runs over a growing source, the second of which fails after its work: each version is committed once."""
    ledger = spark.createDataFrame([], "key string, version string")
    states = [[("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "1")], [("a", "2"), ("b", "2"), ("c", "1")]]
    committed = []
    for n, (state, ok) in enumerate(zip(states, (True, False, True))):
        source = spark.createDataFrame([(k, v, "p", day(n + 1), "x") for k, v in state], SOURCE)
        due = inc.changed_records(source, ledger)
        if ok:
            committed += [(r.key, r.version) for r in due.collect()]
            ledger = inc.advance(ledger, due)
    assert sorted(committed) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")]


def test_stored_bounds_and_debts(spark, tmp_path):
    """Six runs whose ledger, bound and debts lie in files: one fails, one is never closed, rows come late and are superseded.
    Each run reads only rows since the bound and its debts, and yet finds what an audit of the whole source finds."""
    log, states, ledger, bounds, owed, committed = [], [], [], [], [], []
    arrivals = {1: [("a", "1", day(1)), ("b", "1", day(1))], 2: [("a", "2", day(2)), ("c", "1", day(2))], 3: [("d", "1", day(3))], 4: [("late", "1", day(1)), ("b", "0", dt(2024, 12, 1)), ("a", "3", day(4))], 5: [("e", None, day(5))], 6: [("late", "2", day(6)), ("f", "1", day(2))]}
    outcome = {1: "success", 2: "failed", 3: "running", 4: "success", 5: "success", 6: "success"}
    kinds = {"ledger": "key string, version string", "bounds": "project string, reread_from timestamp", "owed": "key string, version string, project string, seen_at timestamp, via string"}
    for n in range(1, 7):
        log += [(k, v, "p", t, "x") for k, v, t in arrivals[n]]
        source = spark.createDataFrame(log, SOURCE)
        for name, rows in (("ledger", ledger), ("bounds", bounds), ("owed", owed)):
            spark.createDataFrame(rows, kinds[name]).write.mode("overwrite").parquet(str(tmp_path / name))
        had = {name: spark.read.parquet(str(tmp_path / name)) for name in kinds}
        due = inc.changed_records(source, had["ledger"], had["bounds"], late="trust", owed=had["owed"])
        found = {(r.key, r.version) for r in due.collect()}
        fresh = {(r.key, r.version) for r in inc.changed_records(source, had["ledger"]).collect()}
        # What came late since the last commit is only in the debts of the next one.
        assert found <= fresh and {k for k, _ in fresh - found} <= {k for k, _, t in arrivals[n] if t < day(n)}
        states.append((n, "p", outcome[n], day(n, 12), None if outcome[n] == "running" else day(n, 13), day(n, 13)))
        if outcome[n] == "success":
            committed += sorted(x for x in found if x[1])
            after = inc.advance(had["ledger"], due)
            new_bounds = inc.reread_from(inc.run_states(spark.createDataFrame(states, RUNS)))
            ledger, bounds = [tuple(r) for r in after.collect()], [tuple(r) for r in new_bounds.collect()]
            owed = [tuple(r) for r in inc.debts(source, after, new_bounds).collect()]
    assert len(committed) == len(set(committed)) and set(committed) | {(r[0], r[1]) for r in owed} >= {("a", "1"), ("b", "1"), ("a", "3"), ("c", "1"), ("d", "1"), ("late", "1"), ("late", "2"), ("f", "1")}
    assert {r[0] for r in owed} == {"f"}


def test_the_bound_is_in_the_plan(spark):
    import os

    from weft.plans import problems

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = problems.p1_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__w") >= 2 and "seen_at" in plan and "Union" in plan


def test_asof_against_brute_force(spark):
    import random

    rng = random.Random(3)
    marks = [(rng.choice("ab"), dt(2025, rng.randint(1, 3), rng.randint(1, 28), rng.randint(0, 23)), i) for i in range(40)] + [("a", None, 99), (None, day(1), 98)]
    rows = [(i, rng.choice("abc"), dt(2025, rng.randint(1, 4), rng.randint(1, 28), rng.randint(0, 23))) for i in range(200)] + [(900, "a", None), (901, None, day(1))]
    got = asof.asof_backward(spark.createDataFrame(rows, "i int, g string, t timestamp"), spark.createDataFrame(marks, "g string, t timestamp, v int"), "g", "t", "t", "v")
    want = {}
    for i, g, t in rows:
        best = [(mt, v) for mg, mt, v in marks if g and t and mg == g and mt and mt <= t]
        want[i] = max(best)[1] if best else None
    assert {r.i: r.v for r in got.collect()} == want
    assert got.select(F.count("*")).first()[0] == len(rows)
