"""Processing only new or changed records.

A run rereads the source from the oldest transaction that was still open at the last successful run, and drops by an
anti-join on (key, version) what a ledger of processed versions already holds. What is older than that bound and still due,
because it came late or a run that owned it failed, is a small table of debts: a run reads what is new and what it owes.
The ledger decides alone whether a record is due, so that a failed run repeats nothing and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.operators.asof import asof_backward


def first_segment(path: Column) -> Column:
    """The project of a path."""
    return F.substring_index(path, "/", 1)


def run_states(runs: DataFrame) -> DataFrame:
    """(run_id, project, started_at, finished_at, status): the state of each run by its latest log row.

    Rows without run_id are ignored. Equal rows are one; of two rows logged at one time the greater status holds."""
    last = runs.where("run_id IS NOT NULL").groupBy("run_id").agg(
        F.max(F.struct("logged_at", "status", "finished_at")).alias("last"), F.max("project").alias("project"), F.min("started_at").alias("started_at"))
    return last.select("run_id", "project", "started_at", F.col("last.finished_at").alias("finished_at"), F.col("last.status").alias("status"))


def reread_from(states: DataFrame) -> DataFrame:
    """(project, reread_from): the start of the oldest run that was open when the last successful run started.

    A run is open at a time when it started by then and had no end by then; a run that was never closed stays open.
    A project without a successful run has no row and is read from the start."""
    done = states.where("status = 'success' AND started_at IS NOT NULL").groupBy("project").agg(F.max("started_at").alias("last_run"))
    open_then = states.join(done, "project").where("started_at <= last_run AND (finished_at IS NULL OR finished_at >= last_run)")
    return open_then.groupBy("project").agg(F.min("started_at").alias("reread_from"))


def processed_ledger(written: DataFrame, states: DataFrame) -> DataFrame:
    """(key, version): the version of each key last written by a run that succeeded.

    ``written`` has key, version, project and written_at. A row belongs to the run of its project with the latest
    start not after written_at. Keys without such a row are not in the ledger."""
    ok = states.where("started_at IS NOT NULL").select("project", "started_at", F.struct(F.col("run_id"), F.coalesce(F.col("status") == "success", F.lit(False)).alias("ok")).alias("run"))
    owned = asof_backward(written.where("key IS NOT NULL AND written_at IS NOT NULL"), ok, "project", "written_at", "started_at", "run")
    return owned.where("run.ok").groupBy("key").agg(F.max(F.struct("written_at", "version")).alias("last")).select("key", F.col("last.version").alias("version"))


def _current(rows: DataFrame) -> DataFrame:
    """The latest row of each key (key, version, project, seen_at, via)."""
    latest = rows.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("seen_at", "version", "project", "via")).alias("now"))
    return latest.select("key", "now.version", "now.project", "now.seen_at", "now.via")


def _missing(current: DataFrame, ledger: DataFrame) -> DataFrame:
    had = ledger.select(F.col("key").alias("__k"), F.col("version").alias("__v"))
    return current.join(had, (F.col("key") == F.col("__k")) & (F.col("version") == F.col("__v")), "left_anti")


def _bounded(source: DataFrame, bounds: DataFrame) -> DataFrame:
    b = bounds.select(F.col("project").alias("__p"), F.col("reread_from").alias("__w"))
    return source.select("key", "version", "project", "seen_at").join(b, F.col("project") == F.col("__p"), "left")


def debts(source: DataFrame, ledger: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, version, project, seen_at, via): what was seen before the bound of its project and is still due.

    Stored when a run commits, it lets the next run read only the rows since the bound. Rows without a time are looked at
    here, since no bound can tell when they came; ``via`` is 'late', or 'reread' for these."""
    rows = _bounded(source, bounds)
    via = F.when(F.col("__w").isNull() | (F.col("seen_at") >= F.col("__w")), "fresh").when(F.col("seen_at").isNull(), "reread").otherwise("late")
    return _missing(_current(rows.select("key", "version", "project", "seen_at", via.alias("via"))).where("via <> 'fresh'"), ledger)


def changed_records(source: DataFrame, ledger: DataFrame, bounds: DataFrame | None = None, late: str = "audit", owed: DataFrame | None = None) -> DataFrame:
    """(key, version, project, seen_at, via): the current version of each key of ``source`` that the ledger lacks.

    ``source`` has key, version, project and seen_at, one row for each version seen; the latest seen_at of a key is
    its current row. ``bounds`` has (project, reread_from): rows since the bound of their project are read, ``via`` 'reread';
    without bounds all are. What is older comes from ``owed``, the stored table of :func:`debts`, ``via`` 'late'. Where none
    is given, ``late="audit"`` works it out from the whole source; ``late="trust"`` does without, which is right only if no
    row is ever late and no run failed before the bound.

    A null version is never processed: it stays due at each run. Null keys are left out. Repeated rows are one; of
    two versions seen at one time the greater holds. Each key comes out once. An empty ledger makes every key due.
    Extra columns of the inputs are ignored.
    """
    if late not in ("audit", "trust"):
        raise ValueError(f"late: {late!r}")
    if bounds is None:
        return _missing(_current(source.withColumn("via", F.lit("reread"))), ledger)
    if owed is None and late == "audit":
        owed = debts(source, ledger, bounds)
    fresh = F.col("__w").isNull() | (F.col("seen_at") >= F.col("__w"))
    rows = _bounded(source, bounds).where(fresh if owed is not None else fresh | F.col("seen_at").isNull())
    rows = rows.select("key", "version", "project", "seen_at", F.lit("reread").alias("via"))
    if owed is not None:
        rows = rows.unionByName(owed.select("key", "version", "project", "seen_at", "via"))
    return _missing(_current(rows), ledger)


def advance(ledger: DataFrame, processed: DataFrame) -> DataFrame:
    """The ledger after a run that succeeded: each key with the version just processed, else the one it had.

    Written as a new table and swapped in when the run commits; a run that fails leaves the old one in place."""
    both = ledger.select("key", "version", F.lit(0).alias("__n")).unionByName(processed.select("key", "version", F.lit(1).alias("__n")))
    return both.groupBy("key").agg(F.max(F.struct("__n", "version")).alias("last")).select("key", F.col("last.version").alias("version"))
