"""Dense, ordered ID assignment without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardline.functions.columns import format_key, key_number
from wardline.session import checkpoint_dir

_PID_SHIFT = 33  # monotonically_increasing_id() = partition index << 33 | row in partition


def next_number(keys: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row (next_no): MAX numeric suffix + 1, or 1 for an empty table.

    Keys whose suffix is not a number are ignored (the reference's CAST
    would fail there and restart numbering at 1).
    """
    return keys.agg(F.max(key_number(F.col(key), prefix)).alias("__m")).select(
        F.coalesce(F.col("__m") + 1, F.lit(1)).alias("next_no"))


def dense_index(df: DataFrame, order: list[str], name: str = "__idx") -> DataFrame:
    """Add a 0-based dense row index following ``order`` (which must be unique).

    The rows are range-partitioned and sorted on ``order``; inside each
    partition the index is the local row number, and each partition adds the
    row count of all partitions before it. Only one count per partition is
    combined (a table with as many rows as partitions), so no task ever
    holds more than its own range. The numbered data is checkpointed to
    ``spark.checkpoint.dir`` so a lost executor recomputes nothing and the
    numbering cannot shift.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
        .checkpoint(eager=True))
    ranged = ranged.withColumn("__pid", F.shiftright("__mid", _PID_SHIFT)).withColumn(
        "__local", F.col("__mid") - F.shiftleft(F.col("__pid"), _PID_SHIFT))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n")).select(
        "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return ranged.join(F.broadcast(offsets), "__pid").withColumn(
        name, F.col("__offset") + F.col("__local")).drop("__mid", "__pid", "__local", "__offset")


def assign_ids(rows: DataFrame, existing_keys: DataFrame, key: str, prefix: str,
               order: list[str]) -> DataFrame:
    """Give ``rows`` new keys PREFIX-NNN continuing after ``existing_keys``.

    The n-th row in ``order`` gets MAX(existing suffix) + n, zero-padded to
    at least three digits and never truncated.
    """
    start = next_number(existing_keys, key, prefix).scalar()  # uncorrelated scalar subquery
    numbered = dense_index(rows, order)
    return numbered.withColumn(key, format_key(prefix, start + F.col("__idx"))).drop("__idx")
