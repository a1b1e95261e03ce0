"""Validated batch ingestion: the reference's six form inserts as Spark jobs.

Reference flow per form post: trim -> required-field check -> key-exists
check -> INSERT (-> second write). Here a whole batch of candidate rows is
classified at once with the same outcome the posts would have had when
applied one by one in ``arrival_seq`` order:

* ``missing_required`` - a required field is blank after trimming;
* ``missing_sequence`` - the row has no ``arrival_seq``, so its turn is unknown;
* ``invalid_value``    - a date or number that the database would refuse;
* ``duplicate_key``    - the key exists in the target or an earlier valid
  candidate of the batch claimed it (first wins);
* ``accepted``.

Rejected rows never claim a key. Candidates that share an ``arrival_seq`` are
taken in the order of their cleaned columns (NULL first), and of rows equal in
all of them one is accepted, so a key has exactly one winner. First-wins is
one keyed ``min`` aggregate over the union of target keys and valid candidate
keys (map-side partials, so a key repeated in a third of the batch is still
one small group), then a join back on the key. Equal rows are counted first
and spread out again at the end. Results are new snapshots; the input tables are never
overwritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardline.functions.columns import (
    CONSULTANT_POSITION,
    ROLE_FORM_CODES,
    blank_to_null,
    clean_text,
    is_blank,
    php_intval,
)
from wardline.operators.skew import salted_join
from wardline.sources.catalog import Tables
from wardline.sources.partitioned import PartitionedTable
from wardline.sources.schemas import KEYS, SCHEMAS

SEQ = "arrival_seq"
DATE_FORMAT = "yyyy-MM-dd"  # what the forms' date inputs post
DEFAULT_CARE_UNITS = 2


OUTCOMES = ("accepted", "missing_required", "missing_sequence", "invalid_value", "duplicate_key")


@dataclass(frozen=True)
class TableChange:
    """What accepted rows do to one table.

    ``apply(target, rows)`` is the table's new version; ``changed(rows)`` has the
    keys (one column named ``key``) whose rows it adds or alters. ``apply`` needs only
    the target rows with those keys, so a partitioned table can be brought up to date
    a few partitions at a time. ``inserts``: accepted rows become new rows, which must
    not be added twice; otherwise ``apply`` repeats without harm.
    """

    target: DataFrame
    key: str
    changed: Callable[[DataFrame], DataFrame]
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    inserts: bool = True

    def repeatable(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        """``apply``, leaving out inserts that an earlier run has made."""
        if self.inserts:
            rows = rows.join(old.select(self.key), self.key, "left_anti")
        return self.apply(old, rows)


@dataclass
class WrittenIngest:
    """Where a batch was written (table -> path), and how many rows had each outcome."""

    paths: dict[str, str]
    counts: dict[str, int]


@dataclass
class IngestResult:
    """``outcome``: every candidate, cleaned, with its outcome; ``changes``: what the
    accepted rows do to the target tables."""

    outcome: DataFrame
    changes: dict[str, TableChange] = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.outcome.where(F.col("outcome") == "accepted").drop("outcome")

    @property
    def rejected(self) -> DataFrame:
        return self.outcome.where(F.col("outcome") != "accepted").withColumnRenamed(
            "outcome", "reason")

    @property
    def snapshots(self) -> dict[str, DataFrame]:
        """The new versions (table -> DataFrame), each from its own classification;
        ``write`` classifies once for all of them."""
        return {table: c.apply(c.target, self.accepted) for table, c in self.changes.items()}

    def _store_outcome(self, path: str, mode: str) -> tuple[IngestResult, dict[str, int]]:
        """Write ``path/_outcome``; the result over what was written, and the number
        of rows per outcome, observed while they were written."""
        seen = Observation("outcomes")
        counted = self.outcome.observe(
            seen, *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES])
        counted.write.mode(mode).parquet(f"{path}/_outcome")
        stored = self.outcome.sparkSession.read.schema(self.outcome.schema).parquet(f"{path}/_outcome")
        return IngestResult(stored, self.changes), dict(seen.get)

    def write(self, path: str, mode: str = "errorifexists") -> WrittenIngest:
        """Write ``path/_outcome``, then, from what was written, one new snapshot
        per table. The default mode never overwrites."""
        stored, counts = self._store_outcome(path, mode)
        paths = {}
        for table, snapshot in stored.snapshots.items():
            snapshot.write.mode(mode).parquet(f"{path}/{table}")
            paths[table] = f"{path}/{table}"
        return WrittenIngest(paths, counts)

    def update(self, stores: dict[str, PartitionedTable], path: str) -> WrittenIngest:
        """Write ``path/_outcome`` and bring the partitioned tables ``stores`` up to
        date: only partitions with a changed key are read and rewritten.

        A partition is replaced as a whole and the change repeats without harm, so an
        interrupted update is simply run again with the same stored outcome.
        """
        stored, counts = self._store_outcome(path, "errorifexists")
        for table, store in stores.items():
            change = self.changes[table]
            store.replace(change.changed(stored.accepted),
                          lambda old, c=change: c.repeatable(old, stored.accepted))
        return WrittenIngest({table: store.path for table, store in stores.items()}, counts)


def optional_date(c: Column | str) -> tuple[Column, Column]:
    """(value, invalid): blank -> NULL date; unparsable -> NULL and invalid."""
    text = blank_to_null(c)
    value = F.try_to_date(text, DATE_FORMAT)
    return value, text.isNotNull() & value.isNull()


def classify(cleaned: DataFrame, target: DataFrame, key: str, required: list[str],
             invalid: Column | None = None) -> DataFrame:
    """Add ``outcome`` to cleaned candidates (see module doc).

    Keys are compared as the target's key column compares them: byte by byte, or
    under its collation (``Tables.collated``).
    """
    missing = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in required])
    reject = F.when(missing, F.lit("missing_required")).when(
        F.col(SEQ).isNull(), F.lit("missing_sequence"))
    if invalid is not None:
        reject = reject.when(invalid, F.lit("invalid_value"))
    columns = cleaned.columns
    marked = cleaned.withColumn("__reject", reject).groupBy(*columns, "__reject").agg(
        F.count(F.lit(1)).alias("__copies"))

    rank = F.struct(F.lit(1).alias("src"), F.col(SEQ).cast("long").alias("seq"),
                    F.struct(*[c for c in columns if c != SEQ]).alias("row"))
    own = F.col(key).cast(target.schema[key].dataType).alias("__key")
    valid = marked.where(F.col("__reject").isNull()).select(own, rank.alias("__rank"))
    # only target keys that some candidate uses matter
    existing = target.select(F.col(key).alias("__key")).join(
        valid.select("__key").distinct(), "__key", "left_semi").select(
        "__key", F.struct(F.lit(0).alias("src"), F.lit(None).cast("long").alias("seq"),
                          F.lit(None).cast(valid.schema["__rank"].dataType["row"].dataType).alias("row"))
        .alias("__rank"))
    winners = valid.unionByName(existing).groupBy("__key").agg(F.min("__rank").alias("__win"))

    # winners is partitioned on the key by its aggregate, so AQE could not
    # split a key repeated across a large share of the batch: salted_join
    # (broadcast when the batch itself is provably small).
    joined = salted_join(marked.withColumn("__key", own), winners, "__key", "left",
                         dim_bound=cleaned).withColumn(
        "__wins", F.col("__reject").isNull() & F.col("__win").eqNullSafe(rank))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    outcome = (F.when(F.col("__reject").isNotNull(), F.col("__reject"))
               .when(F.col("__wins") & (F.col("__copy") == 1), F.lit("accepted"))
               .otherwise(F.lit("duplicate_key")))
    return joined.withColumn("__copy", copy).withColumn("outcome", outcome).select(*columns, "outcome")


def _inserted(t: Tables, name: str) -> TableChange:
    """Accepted rows as new rows of a keyed table."""
    key, fields = KEYS[name], SCHEMAS[name].fields

    def apply(target: DataFrame, rows: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in target.schema.fields}  # collations included
        cols = [f.name for f in fields]
        return target.select(cols).unionByName(
            rows.select([F.col(c).cast(types[c]).alias(c) for c in cols]))

    return TableChange(t[name], key, lambda rows: rows.select(key), apply)


def _member(t: Tables, name: str, condition: Column) -> TableChange:
    """A subtype table (staff_no alone) with those accepted rows that meet
    ``condition`` and that it lacks."""
    change = _inserted(t, name)

    def apply(target: DataFrame, rows: DataFrame) -> DataFrame:
        new = rows.where(condition).select(
            F.col("staff_no").cast(target.schema["staff_no"].dataType).alias("staff_no"))
        return target.select("staff_no").unionByName(new.join(target, "staff_no", "left_anti"))

    return TableChange(change.target, change.key, lambda rows: rows.where(condition).select("staff_no"),
                       apply, inserts=False)


def ingest_specialty(t: Tables, candidates: DataFrame) -> IngestResult:
    cleaned = candidates.select(SEQ, clean_text("specialty_name").alias("specialty_name"))
    out = classify(cleaned, t.specialty, "specialty_name", ["specialty_name"])
    return IngestResult(out, {"specialty": _inserted(t, "specialty")})


def ingest_ward(t: Tables, candidates: DataFrame) -> IngestResult:
    """Wards; number_of_care_units follows PHP intval with default 2.

    No care units are created (the reference only says they would be).
    """
    cleaned = candidates.select(
        SEQ, clean_text("ward_name").alias("ward_name"),
        clean_text("specialty_name").alias("specialty_name"),
        php_intval(F.col("num_care_units"), DEFAULT_CARE_UNITS).alias("number_of_care_units"))
    # a number that no INT column takes is NULL here
    out = classify(cleaned, t.ward, "ward_name", ["ward_name", "specialty_name"],
                   invalid=F.col("number_of_care_units").isNull())
    return IngestResult(out, {"ward": _inserted(t, "ward")})


def ingest_bed(t: Tables, candidates: DataFrame) -> IngestResult:
    cleaned = candidates.select(
        SEQ, clean_text("bed_no").alias("bed_no"),
        clean_text("care_unit_no").alias("care_unit_no"),
        F.lit(0).alias("is_occupied"))
    out = classify(cleaned, t.bed, "bed_no", ["bed_no", "care_unit_no"])
    return IngestResult(out, {"bed": _inserted(t, "bed")})


def bed_occupancy_update(beds: DataFrame, occupied_bed_nos: DataFrame) -> DataFrame:
    """New BED snapshot with is_occupied = 1 for the given bed numbers.

    The keyed UPDATE as a left join on bed_no; unknown bed numbers change
    nothing, as an UPDATE matching no row.
    """
    hits = occupied_bed_nos.select(
        F.col(occupied_bed_nos.columns[0]).cast(beds.schema["bed_no"].dataType).alias("bed_no")
    ).distinct().withColumn("__hit", F.lit(True))
    return beds.join(hits, "bed_no", "left").select(
        "bed_no", "care_unit_no",
        F.when(F.col("__hit"), F.lit(1)).otherwise(F.col("is_occupied")).alias("is_occupied"))


def ingest_patient(t: Tables, candidates: DataFrame) -> IngestResult:
    """Patients; blank dates -> NULL; each accepted bed becomes occupied.

    Like the reference server side, neither bed vacancy nor bed-in-unit is
    checked (only the picker filters). Both snapshots derive from the same
    accepted rows.
    """
    dob, dob_bad = optional_date("dob")
    admitted, admitted_bad = optional_date("date_admitted")
    cleaned = candidates.select(
        SEQ, clean_text("patient_no").alias("patient_no"),
        clean_text("patient_name").alias("patient_name"),
        dob.alias("date_of_birth"), admitted.alias("date_admitted"),
        clean_text("care_unit_no").alias("care_unit_no"), clean_text("bed_no").alias("bed_no"),
        (dob_bad | admitted_bad).alias("__bad"))
    out = classify(cleaned, t.patient, "patient_no",
                   ["patient_no", "patient_name", "care_unit_no", "bed_no"],
                   invalid=F.col("__bad")).drop("__bad")
    return IngestResult(out, {
        "patient": _inserted(t, "patient"),
        "bed": TableChange(t.bed, "bed_no", lambda rows: rows.select("bed_no"),
                           lambda beds, rows: bed_occupancy_update(beds, rows.select("bed_no")),
                           inserts=False)})


def ingest_doctor(t: Tables, candidates: DataFrame) -> IngestResult:
    """Doctors; the consultant flag forces position 'consultant' and adds a
    CONSULTANT row. A blank position stays '' (not NULL)."""
    joined, joined_bad = optional_date("date_joined")
    flag = F.coalesce(F.col("is_consultant").cast("boolean"), F.lit(False))
    cleaned = candidates.select(
        SEQ, clean_text("staff_no").alias("staff_no"), clean_text("name").alias("name"),
        F.when(flag, F.lit(CONSULTANT_POSITION)).otherwise(
            F.coalesce(clean_text("position"), F.lit(""))).alias("position"),
        joined.alias("date_joined_team"),
        clean_text("specialty_name").alias("specialty_name"),
        blank_to_null("consultant_staff_no").alias("consultant_staff_no"),
        flag.alias("is_consultant"), joined_bad.alias("__bad"))
    out = classify(cleaned, t.doctor, "staff_no", ["staff_no", "name", "specialty_name"],
                   invalid=F.col("__bad")).drop("__bad")
    return IngestResult(out, {
        "doctor": _inserted(t, "doctor"),
        "consultant": _member(t, "consultant", F.col("is_consultant"))})


def ingest_nurse(t: Tables, candidates: DataFrame) -> IngestResult:
    """Nurses routed to one role table by the form's role code.

    An unknown role keeps the nurse without a role row. Unit-in-ward is not
    checked (as in the reference).
    """
    role_code = clean_text("role")
    table = F.lit(None).cast("string")
    for code, role_table in ROLE_FORM_CODES.items():
        table = F.when(role_code == F.lit(code), F.lit(role_table)).otherwise(table)
    cleaned = candidates.select(
        SEQ, clean_text("staff_no").alias("staff_no"), clean_text("name").alias("name"),
        clean_text("ward_name").alias("ward_name"),
        clean_text("care_unit_no").alias("care_unit_no"),
        role_code.alias("role"), table.alias("role_table"))
    out = classify(cleaned, t.nurse, "staff_no",
                   ["staff_no", "name", "ward_name", "care_unit_no", "role"])
    roles = {role: _member(t, role, F.col("role_table") == role) for role in ROLE_FORM_CODES.values()}
    return IngestResult(out, {"nurse": _inserted(t, "nurse"), **roles})


def nurse_role_rows(t: Tables, result: IngestResult) -> DataFrame:
    """(role_table, staff_no) of all four role tables after a nurse batch: one plan
    over one classification."""
    types = t.day_sister.schema["staff_no"].dataType
    now = reduce(DataFrame.unionByName, [
        t[role].select(F.lit(role).alias("role_table"), "staff_no") for role in ROLE_FORM_CODES.values()])
    new = result.accepted.where(F.col("role_table").isNotNull()).select(
        "role_table", F.col("staff_no").cast(types).alias("staff_no"))
    return now.unionByName(new.join(now, ["role_table", "staff_no"], "left_anti"))
