"""Explicit salting of hot join keys.

AQE splits a skewed sort-merge join only when both inputs are plain shuffle
stages. When one side is itself an aggregate or a join already partitioned
on the join key (a per-patient filter, a doctor table with its consultant
flag), no exchange sits under the join and a key holding a third of the
fact stays in one task. ``salted_join`` handles those joins:

1. count fact rows per key (map-side partial aggregation);
2. hot keys are the ones holding more rows than an average shuffle partition,
   so there are fewer of them than partitions: a broadcast with a proven bound;
3. a hot key's fact rows spread over ``salts`` buckets by a hash of the whole
   row (deterministic, so a recomputed task routes rows the same way), with
   ``salts`` proportional to the key's share of the rows (rows identical in
   every column share a bucket; results are unaffected either way);
4. the matching dimension rows are replicated once per salt (salts
   follow the key's share, so at most about twice the shuffle partitions);
5. the join runs on (key, salt); every fact row meets exactly one replica,
   so the result equals the unsalted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.joins import provably_small

_SALT, _SALTS, _N = "__salt", "__salts", "__n"


def hot_keys(counts: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, __salts) for keys with more than total / parts rows.

    ``counts`` has columns (key, __n). Fewer than ``parts`` rows qualify
    (their counts would otherwise exceed the total). A key with share s of
    all rows gets ceil(s * parts) salts, at least 2 and at most ``parts``.
    """
    total = counts.agg(F.sum(_N)).scalar()
    salts = F.least(F.lit(parts), F.greatest(F.lit(2), F.ceil(F.col(_N) * parts / total)))
    return counts.where(F.col(_N) * parts > total).select(
        key, salts.cast("int").alias(_SALTS))


def salted_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                counts: DataFrame | None = None, dim_bound: DataFrame | None = None,
                max_bytes: int | None = None) -> DataFrame:
    """``fact JOIN dim USING (key)`` (inner or left) with hot keys salted.

    When statistics prove ``dim_bound`` (a table with at least as many rows as
    ``dim``, default ``dim`` itself) small (``provably_small``),
    ``dim`` is broadcast instead: a broadcast hash join streams the fact
    without a shuffle, so hot keys cost nothing extra. ``counts`` (key, __n)
    may be passed when the caller already aggregates the fact per key.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    bound_df = dim if dim_bound is None else dim_bound
    if provably_small(bound_df, max_bytes):
        return fact.join(F.broadcast(dim), key, how)
    parts = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = fact.groupBy(key).agg(F.count(F.lit(1)).alias(_N))
    hot = F.broadcast(hot_keys(counts, key, parts))  # fewer than `parts` rows by construction
    fact_cols = fact.columns
    salted_fact = fact.join(hot, key, "left").withColumn(
        _SALT, F.when(F.col(_SALTS).isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in fact_cols]), F.col(_SALTS)).cast("int"))
    ).drop(_SALTS)
    salted_dim = dim.join(hot, key, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
    ).drop(_SALTS)
    return salted_fact.join(salted_dim, [key, _SALT], how).drop(_SALT)
