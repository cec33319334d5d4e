"""Backward as-of join of many rows to few, by time within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def asof_backward(rows: DataFrame, marks: DataFrame, by: str, row_ts: str, mark_ts: str, value: str) -> DataFrame:
    """``rows`` plus column ``value`` of the mark with the latest ``mark_ts`` not after ``row_ts`` in the same ``by``.

    The marks become half-open intervals. Each closed interval is listed under the days it covers, so that the join
    is an equi-join on (group, day) with a residual time test: no window runs over the rows, a hot group is spread
    over its days, and adaptive execution can split what is still skewed because the mark side is small per key. The
    last interval of a group has no end and is one row a group.

    Rows with a null group or time, or before the first mark, get a null ``value``. Marks with a null group or time
    are ignored; of several marks at one time the greatest ``value`` holds. An extra column of ``rows`` named like
    one of ``marks`` is kept as it is, and a column of ``rows`` already called ``value`` is replaced.
    """
    marks = marks.select(F.col(by).alias("__by"), F.col(mark_ts).alias("__from"), F.col(value).alias("__value"))
    marks = marks.where("__by IS NOT NULL AND __from IS NOT NULL").groupBy("__by", "__from").agg(F.max("__value").alias("__value"))
    spans = marks.withColumn("__to", F.lead("__from").over(W.partitionBy("__by").orderBy("__from")))
    last = spans.where("__to IS NULL").select(F.col("__by").alias("__lby"), F.col("__from").alias("__lfrom"), F.col("__value").alias("__lvalue"))
    closed = spans.where("__to IS NOT NULL").select(
        F.col("__by").alias("__cby"), F.explode(F.sequence(_day(F.col("__from")), _day(F.col("__to")))).alias("__cday"),
        F.col("__from").alias("__cfrom"), F.col("__to").alias("__cto"), F.col("__value").alias("__cvalue"))
    kept = [c for c in rows.columns if c != value]
    rows = rows.join(last, rows[by] == F.col("__lby"), "left")
    open_ended = F.col(row_ts) >= F.col("__lfrom")
    rows = rows.withColumn("__day", F.when(~F.coalesce(open_ended, F.lit(False)), _day(F.col(row_ts))))
    rows = rows.join(closed, (F.col(by) == F.col("__cby")) & (F.col("__day") == F.col("__cday")) & (F.col(row_ts) >= F.col("__cfrom")) & (F.col(row_ts) < F.col("__cto")), "left")
    return rows.select(*kept, F.when(open_ended, F.col("__lvalue")).otherwise(F.col("__cvalue")).alias(value))
