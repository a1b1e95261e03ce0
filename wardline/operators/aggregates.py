"""Keyed pre-aggregates that replace correlated subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str, name: str, condition: Column | None = None) -> DataFrame:
    """(key, name) counts per key; joins back with ``attach_counts``."""
    value = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.groupBy(key).agg(value.alias(name))


def attach_counts(left: DataFrame, counts: DataFrame, key: str, left_key: str | None = None) -> DataFrame:
    """Left-join pre-aggregated counts; keys with no rows count 0.

    The correlated ``(SELECT COUNT(*) ... WHERE k = outer.k)`` form: one
    aggregate with map-side partials and one join, never a join first and
    a count after (that would fan out).
    """
    left_key = left_key or key
    names = [c for c in counts.columns if c != key]
    counts = counts.withColumnRenamed(key, "__k")
    joined = left.join(counts, F.col(left_key) == F.col("__k"), "left").drop("__k")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in names])


def latest_by(df: DataFrame, key: str, value: str, order: list[str], name: str) -> DataFrame:
    """(key, name) = ``value`` of the row with the largest ``order`` tuple.

    ``max_by`` keeps one running candidate per key in the map-side partial
    aggregate, so a key with a third of all rows costs no more memory than
    any other. Rows with a NULL first order field lose to dated rows.
    """
    return df.groupBy(key).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(name))
