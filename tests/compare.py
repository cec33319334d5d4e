"""Runs queries beside their SQL on one data folder: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_duckdb(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    cols = sorted(names)
    return cols, Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def differs(spark, sf_dir, query, sql):
    """None if both give the same columns and rows, else what differs."""
    got, want = rows_of_spark(query(spark, sf_dir)), rows_of_duckdb(sf_dir, sql)
    if got == want:
        return None, sum(got[1].values())
    return f"columns {got[0]} / {want[0]}; {sum(got[1].values())} / {sum(want[1].values())} rows; only here {list((got[1] - want[1]).items())[:4]}; only SQL {list((want[1] - got[1]).items())[:4]}", sum(got[1].values())


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from weft.session import local_session

    spark, queries, oracle, bad = local_session(8), entry.queries(), entry.oracle_sql(), 0
    for name in [n for n in queries if not names or any(n.startswith(x) for x in names)]:
        began = time.time()
        try:
            if name in oracle:
                why, n = differs(spark, sf_dir, queries[name], oracle[name])
            else:
                why, n = None, queries[name](spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            why, n = "\n".join(str(e).split("\n")[:12])[:1800], -1
        bad += why is not None
        print(f"{'OK  ' if why is None else 'BAD '} {name}: {n} rows, {time.time() - began:.1f} s{'' if name in oracle else ' (no SQL)'} {why or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
