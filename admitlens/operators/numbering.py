"""Consecutive row numbers without a single-task window.

The usual ``row_number() over (order by …)`` without ``partitionBy`` sends
every row to one task. Here: a distributed sort (range partitioning), a
reliable checkpoint so that every later pass sees identical partitions, a
per-partition count (one row per partition), running offsets over that tiny
frame, and a broadcast join of the offsets back. Work is linear and spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.session import cut_lineage, maybe_broadcast

_PID, _MID = "_nb_pid", "_nb_mid"


def with_row_index(df: DataFrame, order: list[Column | str] | None = None,
                   start: Column | int = 0, name: str = "row_index") -> DataFrame:
    """Add ``name`` = start, start+1, … following ``order`` (physical order if None).

    ``order`` should be unique per row for a deterministic result."""
    s = df.orderBy(*order) if order else df
    s = s.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())
    s = cut_lineage(s)
    counts = s.groupBy(_PID).agg(F.count(F.lit(1)).alias("_nb_n"))
    offsets = counts.select(
        _PID,
        (F.sum("_nb_n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_nb_n")).alias("_nb_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    out = s.join(maybe_broadcast(offsets, 1_000_000), _PID).withColumn(
        name, (start_col + F.col("_nb_off") + local).cast("long"))
    return out.drop(_PID, _MID, "_nb_off")


def running_totals(df: DataFrame, order_col: str, value_col: str, name: str) -> DataFrame:
    """Add ``name`` = sum of ``value_col`` over all rows before in ``order_col``:
    range partitions, a running sum inside each, and the sums of the partitions
    before it (one row per partition)."""
    parts = cut_lineage(df.repartitionByRange(order_col).withColumn(_PID, F.spark_partition_id()))
    inside = F.sum(value_col).over(Window.partitionBy(_PID).orderBy(order_col)
                                   .rowsBetween(Window.unboundedPreceding, -1))
    sums = parts.groupBy(_PID).agg(F.sum(value_col).alias("_nb_n"))
    before = sums.select(_PID, F.coalesce(F.sum("_nb_n").over(
        Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_nb_off"))
    return (parts.withColumn(name, F.coalesce(inside, F.lit(0))).join(before, _PID)
            .withColumn(name, (F.col(name) + F.col("_nb_off")).cast("long")).drop(_PID, "_nb_off"))
