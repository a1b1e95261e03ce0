"""Nurse role resolution as one keyed aggregate instead of four lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import NURSE_ROLES, ROLE_LABELS
from wardline.operators.joins import bounded_broadcast


def role_rows(tables) -> DataFrame:
    """(staff_no, role, priority) for every row of the four role tables."""
    parts = [
        tables[role].select("staff_no", F.lit(role).alias("role"), F.lit(rank).alias("priority"))
        for rank, role in enumerate(NURSE_ROLES, start=1)
    ]
    return reduce(DataFrame.unionByName, parts)


def primary_role(tables, only: DataFrame | None = None) -> DataFrame:
    """(staff_no, role) with Day > Night > Staff > Non-Reg priority.

    One aggregate with map-side partials replaces four left joins: the
    union of role keys is shuffled once by staff_no. ``only`` (staff_no
    keys) narrows the role rows first, map-side when those keys are
    provably few (a single-ward lookup).
    """
    rows = role_rows(tables)
    if only is not None:
        rows = rows.join(bounded_broadcast(only.select("staff_no")), "staff_no", "left_semi")
    best = rows.groupBy("staff_no").agg(F.min("priority").alias("priority"))
    label = F.lit(None).cast("string")
    for rank, role in reversed(list(enumerate(NURSE_ROLES, start=1))):
        label = F.when(F.col("priority") == rank, F.lit(ROLE_LABELS[role])).otherwise(label)
    return best.select("staff_no", label.alias("role"))


def with_role_label(nurses: DataFrame, tables, fallback: str,
                    narrow: bool = False) -> DataFrame:
    """Left-join the primary role label; nurses with none get ``fallback``.

    ``narrow=True`` when ``nurses`` is a filtered subset (see primary_role).
    """
    roles = primary_role(tables, nurses if narrow else None).withColumnRenamed("role", "__role")
    return nurses.join(roles, "staff_no", "left").withColumn(
        "role", F.coalesce(F.col("__role"), F.lit(fallback))).drop("__role")

