"""Join helpers: size-checked broadcast and key restriction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A dimension is broadcast only when the statistics of its files or catalog entry
# put it below this many stored bytes (a few times as much in memory).
BROADCAST_MAX_BYTES = 8 * 1024 * 1024
# Session override, e.g. 0 to plan every join as if all tables were large.
CONF_BROADCAST_MAX_BYTES = "wardline.broadcast.maxBytes"
# Lists measured in memory may take this many times the limit on stored bytes.
LISTS_PER_STORED_BYTE = 8


def stored_bytes(df: DataFrame) -> int:
    """Size of ``df`` from file or catalog statistics; starts no Spark job.

    A plan over one table counts as the whole table, whatever it filters or
    projects. Over several tables Catalyst's estimate is taken, which for joins
    is the product of the sides and so errs on the large side.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1:
        plan = leaves.head()
    return int(plan.stats().sizeInBytes())


def broadcast_limit(df: DataFrame) -> int:
    """The session's limit on the stored bytes of a broadcast table."""
    return int(df.sparkSession.conf.get(CONF_BROADCAST_MAX_BYTES, str(BROADCAST_MAX_BYTES)))


def provably_small(df: DataFrame, max_bytes: int | None = None) -> bool:
    """True when statistics bound ``df`` by the session's broadcast limit."""
    if max_bytes is None:
        max_bytes = broadcast_limit(df)
    return max_bytes > 0 and stored_bytes(df) <= max_bytes


def bounded_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast only for a side whose stored size is known to be small.

    Above the bound the plain DataFrame is returned and the planner (with AQE
    measuring real shuffle sizes) picks the join.
    """
    return F.broadcast(df) if provably_small(df, max_bytes) else df


Keys = None | str | Iterable[str] | DataFrame


def restrict(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """Keep rows whose ``column`` is in ``keys``.

    ``None`` keeps every row (the full batch extract); a string or a short
    list becomes an ``=``/``IN`` predicate that reaches the Parquet scan; a
    DataFrame of keys (one column) becomes a left-semi join, which scales to
    any number of keys.
    """
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        key_col = keys.columns[0]
        return semi_join(df, keys.select(F.col(key_col).alias(column)), column)
    if isinstance(keys, str):
        return df.where(F.col(column) == F.lit(keys))
    return df.where(F.col(column).isin(list(keys)))


def semi_join(df: DataFrame, keys: DataFrame, column: str, max_bytes: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``keys`` (one column).

    A shuffle join would move all rows of ``df`` to keep few. The distinct keys are
    measured while the query runs, and a filter lets the rows into one of two branches:
    a broadcast of keys that take up to ``LISTS_PER_STORED_BYTE`` times the broadcast
    limit, or the shuffle join. A limit of 0 plans the shuffle join alone.
    """
    if max_bytes is None:
        max_bytes = broadcast_limit(df)
    if max_bytes <= 0:
        return df.join(keys, column, "left_semi")
    distinct = keys.where(F.col(column).isNotNull()).distinct()
    # 32 bytes a key for what a hash table holds beside its text
    measured = distinct.agg(F.coalesce(
        F.sum(F.octet_length(F.col(column).cast("string")) + 32), F.lit(0))).scalar()
    few = measured <= F.lit(max_bytes * LISTS_PER_STORED_BYTE)
    return (
        df.where(few).join(F.broadcast(distinct.where(few)), column, "left_semi")
        .unionByName(df.where(~few).join(distinct.where(~few), column, "left_semi")))


def left_join_hot_right(left: DataFrame, right: DataFrame, key: str,
                        bound: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` for a right side with hot keys.

    When statistics prove ``bound`` (a table with at least as many rows as
    ``right``) small, ``right`` is broadcast and ``left`` is not shuffled.

    AQE can split a skewed partition only on the preserved side of an outer
    join, so a right-side key holding a third of all rows would land in one
    task. Written as an inner join (both sides splittable) plus the left rows
    without any match (anti join against the right's distinct keys, which
    collapse map-side), the result is the same rows.
    """
    if bound is not None and provably_small(bound):
        return left.join(F.broadcast(right), key, "left")
    matched = left.join(right, key)
    right_only = [f for f in right.schema.fields if f.name != key]
    unmatched = left.join(right.select(key).distinct(), key, "left_anti").select(
        *[F.col(c) for c in left.columns],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in right_only])
    return matched.select(unmatched.columns).unionByName(unmatched)


def expand_in_order(left: DataFrame, right: DataFrame, key: str, order_prefix: list[str],
                    max_bytes: int | None = None) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` for a one-to-many right side, sorted by
    ``order_prefix`` (left columns) and then by the right side's columns.

    The fanned-out rows are many times the inputs, so they are neither shuffled nor
    sorted where the right side fits a broadcast: the narrow left rows are
    range-partitioned and sorted on ``order_prefix``, and each is expanded by its key's
    sorted list (``_expand_sorted``). Statistics may prove that; otherwise the lists are
    measured while the query runs, and a filter lets the rows into one of two branches:
    the lists up to ``LISTS_PER_STORED_BYTE`` times the broadcast limit, or the skew-safe
    shuffle join of ``left_join_hot_right`` with a sort of its rows. A limit of 0 plans
    the shuffle join alone.
    """
    if max_bytes is None:
        max_bytes = broadcast_limit(left)
    right_only = [c for c in right.columns if c != key]
    lists = right.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*right_only))).alias("__list"))
    if provably_small(right, max_bytes):
        return _expand_sorted(left, lists, key, order_prefix, right_only)

    def shuffled(rows: DataFrame) -> DataFrame:
        return left_join_hot_right(rows, right, key).orderBy(*order_prefix, *right_only)

    if max_bytes <= 0:
        return shuffled(left)
    text = F.concat_ws("", *[F.col(c).cast("string") for c in right.columns])
    # 32 bytes a row for what an array element holds beside its text
    measured = right.agg(F.coalesce(F.sum(F.octet_length(text) + 32), F.lit(0))).scalar()
    few = measured <= F.lit(max_bytes * LISTS_PER_STORED_BYTE)
    broadcast = _expand_sorted(left.where(few), lists.where(few), key, order_prefix, right_only)
    return broadcast.unionByName(shuffled(left.where(~few)).select(broadcast.columns))


def _expand_sorted(left: DataFrame, lists: DataFrame, key: str, order_prefix: list[str],
                   right_only: list[str]) -> DataFrame:
    """Left rows in the order of ``order_prefix``, each with the entries of its key's list.

    The windows need the rows sorted by ``order_prefix``, which the range partitioning
    allows without a shuffle, and the broadcast join and the windows keep that order.
    Rows alike in ``order_prefix`` are merged into one list whose entries bring the
    row's other columns (``__own``), so that the order holds for them too.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in left.columns if c not in order_prefix] or [key]
    own = F.struct(*[F.col(c) for c in rest])
    no_own = F.lit(None).cast(left.select(own.alias("o")).schema["o"].dataType)
    # without entries a left row stays, with NULLs
    lists = lists.withColumn("__list", F.transform("__list", lambda entry: entry.withField("__own", no_own)))
    nothing = F.array(F.struct(*[
        F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema["__list"].dataType.elementType.fields]))
    alike = Window.partitionBy(*order_prefix)
    rows = (
        left.repartitionByRange(parts, *order_prefix)
        .withColumn("__place", F.row_number().over(alike.orderBy(*rest)))
        .withColumn("__alike", F.count(F.lit(1)).over(alike))
        .join(F.broadcast(lists), key, "left")
        .withColumn("__list", F.coalesce("__list", nothing)))
    entries = F.transform("__list", lambda entry: entry.withField("__own", own))
    merged = F.flatten(F.collect_list(F.when(F.col("__alike") > 1, entries)).over(alike))
    return (
        rows.withColumn("__merged", merged).where("__place = 1")
        .select(*left.columns, F.inline(
            F.when(F.col("__alike") > 1, F.sort_array("__merged")).otherwise(F.col("__list"))))
        .select(*[F.when(F.col("__own").isNull(), F.col(c)).otherwise(F.col("__own")[c]).alias(c)
                  if c in rest else F.col(c) for c in left.columns], *right_only))
