"""Integrity audit: what the jobs take for granted about keys and references.

The reports join on keys that the reference leaves to its database. One report lists
every rule with the number of rows that break it, also where there are none:

* ``duplicate_key``   - rows beyond the first of their key;
* ``null_key``        - rows without a key;
* ``orphan``          - rows whose reference names no key of the other table;
* ``null_reference``  - rows without a reference that must be there;
* ``unit_of_other_ward`` - nurses whose care unit lies in another ward than theirs;
* ``bed_of_other_unit``  - patients whose bed belongs to another care unit than theirs.

Keys and references are reduced to counts per value first (map-side partials), so a
value that a third of all rows share is one row when keys and references meet, and
all relationships meet in one shuffle on (table, key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.catalog import Tables
from wardline.sources.schemas import KEYS, OPTIONAL_REFERENCES, REFERENCES

RULES: tuple[tuple[str, str, str], ...] = (
    *((table, key, rule) for table, key in KEYS.items() for rule in ("duplicate_key", "null_key")),
    *((table, column, "orphan") for table, column, _ in REFERENCES),
    *((table, column, "null_reference") for table, column, _ in REFERENCES
      if (table, column) not in OPTIONAL_REFERENCES),
    ("nurse", "care_unit_no", "unit_of_other_ward"),
    ("patient", "bed_no", "bed_of_other_unit"),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _values(t: Tables, uses: dict[str, list[tuple[str, str]]], collation: str | None) -> DataFrame:
    """(table_name, column_name, parent, key, n): counts per value of the columns in
    ``uses`` (table -> (column, parent)), from one scan of each table and one shuffle."""
    parts = []
    for table, pairs in uses.items():
        columns = [F.struct(F.lit(column).alias("column_name"), F.lit(parent).alias("parent"),
                            F.col(column).cast("string").alias("key")) for column, parent in pairs]
        parts.append(t[table].select(F.lit(table).alias("table_name"), F.inline(F.array(*columns))))
    by = ["table_name", "column_name", "parent", "key"]
    return _counted(_union(parts), by, {"key": collation} if collation else {})


def _counted(rows: DataFrame, by: list[str], collations: dict[str, str]) -> DataFrame:
    """Rows of ``rows`` per ``by``, as n, the columns of ``collations`` compared under theirs.

    Spark groups collated strings by sorting the rows. The spellings are counted as
    plain strings first, in a hash aggregate, so that only one row per spelling is sorted.
    """
    spelled = rows.withColumns({c: F.col(c).cast("string") for c in collations}) if collations else rows
    counts = spelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if not collations:
        return counts
    collated = counts.withColumns({c: F.collate(c, name) for c, name in collations.items()})
    return collated.groupBy(*by).agg(F.sum("n").alias("n"))


def _example(collation: str | None) -> Column:
    """The smallest value; under a collation without the letter case and trailing
    spaces that it passes over."""
    key = F.col("key")
    return F.min(F.lower(F.rtrim(key.cast("string"))) if collation else key)


def _found(rows: DataFrame, rule: str, collation: str | None, surplus: int = 0) -> DataFrame:
    return rows.groupBy("table_name", "column_name").agg(
        F.sum(F.col("n") - surplus).alias("n_rows"), F.count("key").alias("n_keys"),
        _example(collation).alias("example_key")).withColumn("rule", F.lit(rule))


def _mismatched(child: DataFrame, parent: DataFrame, key: str, own: str, theirs: str, table: str,
                column: str, rule: str, collation: str | None) -> DataFrame:
    """Rows of ``child`` whose ``own`` differs from ``theirs`` of the row they refer to.

    (key, own) pairs are counted first, so a key that many rows share is few rows.
    """
    pairs = _counted(child, [key, own], {c: collation for c in (key, own)} if collation else {})
    parents = parent.select(F.col(key), F.col(theirs).alias("__theirs"))
    wrong = pairs.join(parents, key).where(F.col(own) != F.col("__theirs"))
    wrong = wrong.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("n"))
    return _found(wrong.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                               "key", "n"), rule, collation)


def audit_integrity(t: Tables, collation: str | None = None) -> DataFrame:
    """table_name, column_name, rule, n_rows, n_keys, example_key for all RULES.

    ``n_keys`` counts the values concerned, ``example_key`` is the smallest of them.
    With ``collation`` keys are compared under it.
    """
    if collation:
        t = t.collated(collation)
    keys = _values(t, {table: [(key, table)] for table, key in KEYS.items()}, collation)
    by_child: dict[str, list[tuple[str, str]]] = {}
    for table, column, parent in REFERENCES:
        by_child.setdefault(table, []).append((column, parent))
    uses = _values(t, by_child, collation)

    known = keys.where(F.col("key").isNotNull())
    orphans = uses.where(F.col("key").isNotNull()).join(known.select("parent", "key"), ["parent", "key"],
                                                       "left_anti")
    found = [
        _found(known.where("n > 1"), "duplicate_key", collation, surplus=1),
        _found(keys.where(F.col("key").isNull()), "null_key", collation),
        _found(orphans, "orphan", collation),
        _found(uses.where(F.col("key").isNull()), "null_reference", collation),
        _mismatched(t.nurse.select("care_unit_no", "ward_name"), t.care_unit, "care_unit_no", "ward_name",
                    "ward_name", "nurse", "care_unit_no", "unit_of_other_ward", collation),
        _mismatched(t.patient.select("bed_no", "care_unit_no"), t.bed, "bed_no", "care_unit_no",
                    "care_unit_no", "patient", "bed_no", "bed_of_other_unit", collation),
    ]
    rules = t.specialty.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                 F.lit(rule).alias("rule")) for table, column, rule in RULES])))
    order = ["table_name", "column_name", "rule"]
    # the findings are one row per rule at most
    return (rules.join(F.broadcast(_union(found)), order, "left")
            .select(*order, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                    F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"), "example_key")
            .orderBy(*order))
