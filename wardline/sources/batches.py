"""Ingestion scenarios derived from the test tables.

For an entity with integer source key k, the *target* holds the rows with
k % 10 < 8 and the candidate batch holds the rows with k % 10 >= 7, so
every source row takes part and all outcomes occur:

* k % 10 == 7: key already in the target -> duplicate_key;
* k % 10 == 8: a later second copy of the key -> duplicate_key (first wins);
* k % 10 == 9: an earlier copy with a blank required field arrives first ->
  missing_required, and the later valid copy is still accepted (rejected
  rows never claim a key); with k % 7 == 0 a bad date makes that valid
  copy invalid_value as well.

* k % 30 == 29: an identical second copy with the same arrival_seq, and
* k % 30 == 19: another copy with the same arrival_seq but a changed field ->
  exactly one of each is accepted;
* k % 20 == 9: a further copy without arrival_seq -> missing_sequence.

Keys with k % 3 == 0 arrive padded with a space and a tab, to be trimmed.
arrival_seq = 3k (early blank copy), 3k + 1 (main), 3k + 2 (late copy). Wards
with k % 25 == 18 ask for more care units than an integer holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.columns import format_key, key_number
from wardline.sources.catalog import Tables
from wardline.sources.fixtures import (
    POSITION_BY_SUPPKEY_MOD6,
    build_tables,
    nurse_segment,
    read_sources,
)

# Fixed values of the scenario.
BLANK = " \t "
BAD_DATE = "1990-13-45"
DUP_SUFFIX = " II"
ROLE_CODE_BY_PART_TYPE = {
    "ECONOMY": "day_sister",
    "LARGE": "night_sister",
    "MEDIUM": "staff_nurse",
    "PROMO": "staff_nurse",
    "SMALL": "non_reg",
}
UNKNOWN_ROLE = "matron"
TARGET_MOD10_BELOW = 8


def _batch(src: DataFrame, k: Column, key: str, fields: dict[str, Column], blank_field: str,
           dup_field: str | None) -> DataFrame:
    base = src.where(k % 10 >= 7)
    padded = F.when(k % 3 == 0, F.concat(F.lit(" "), fields[key], F.lit("\t"))).otherwise(
        fields[key])

    def rows(where: Column, seq: Column, **over: Column) -> DataFrame:
        cols = {**fields, key: padded, **over}
        return base.where(where).select(seq.cast("long").alias("arrival_seq"),
                                        *[c.alias(n) for n, c in cols.items()])

    main = rows(F.lit(True), k * 3 + 1)
    early = rows(k % 10 == 9, k * 3, **{blank_field: F.lit(BLANK)})
    late_over = {} if dup_field is None else {
        dup_field: F.concat(fields[dup_field], F.lit(DUP_SUFFIX))}
    late = rows(k % 10 == 8, k * 3 + 2, **late_over)
    tied = rows(k % 30 == 29, k * 3 + 1)
    changed = rows(k % 30 == 19, k * 3 + 1, **late_over)
    unordered = rows(k % 20 == 9, F.lit(None))
    return reduce(DataFrame.unionByName, [main, early, late, tied, changed, unordered])


def _date_text(d: Column, blank_when: Column, bad_when: Column) -> Column:
    text = F.date_format(d, "yyyy-MM-dd")
    return F.when(bad_when, F.lit(BAD_DATE)).when(blank_when, F.lit("")).otherwise(text)


def _target(t: Tables, name: str, key: str, prefix: str | None) -> DataFrame:
    df = t[name]
    if prefix is None:  # specialty / ward keys end in the nation number
        num = F.regexp_extract(F.col(key), r"(\d+)$", 1).cast("int")
    else:
        num = key_number(F.col(key), prefix)
    return df.where(num % 10 < TARGET_MOD10_BELOW)


def target_tables(full: Tables, nation: DataFrame) -> Tables:
    """The scenario's target: rows whose source key k has k % 10 < 8."""
    return full.replace(
        specialty=full.specialty.join(
            nation.where(F.col("n_nationkey") % 10 < TARGET_MOD10_BELOW).select(
                F.col("n_name").alias("specialty_name")), "specialty_name", "left_semi"),
        ward=_target(full, "ward", "ward_name", None),
        bed=_target(full, "bed", "bed_no", "BED"),
        patient=_target(full, "patient", "patient_no", "PAT"),
        doctor=_target(full, "doctor", "staff_no", "DOC"),
        consultant=_target(full, "consultant", "staff_no", "DOC"),
        nurse=_target(full, "nurse", "staff_no", "NUR"),
        day_sister=_target(full, "day_sister", "staff_no", "NUR"),
        night_sister=_target(full, "night_sister", "staff_no", "NUR"),
        staff_nurse=_target(full, "staff_nurse", "staff_no", "NUR"),
        non_reg_nurse=_target(full, "non_reg_nurse", "staff_no", "NUR"),
    )


def scenario(spark: SparkSession, sf_dir: str) -> tuple[Tables, Tables, dict[str, DataFrame]]:
    """(full tables, target tables, candidate batch per entity)."""
    full = build_tables(spark, sf_dir)
    src = read_sources(spark, sf_dir)
    return full, target_tables(full, src["nation"]), candidate_batches(src)


def candidate_batches(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One candidate batch per entity (all text fields, as form posts)."""
    nation, customer, supplier, part = src["nation"], src["customer"], src["supplier"], src["part"]
    batches: dict[str, DataFrame] = {}
    nk = F.col("n_nationkey")
    batches["specialty"] = _batch(nation, nk, "specialty_name",
                                  {"specialty_name": F.col("n_name")}, "specialty_name", None)
    units = F.when(nk % 25 == 18, F.lit("99999999999")).when(nk % 4 == 0, F.lit(None)).when(nk % 4 == 1, F.lit(" 3")).when(
        nk % 4 == 2, F.lit("4 units")).otherwise(F.lit("x"))
    batches["ward"] = _batch(nation, nk, "ward_name", {
        "ward_name": F.concat(F.lit("WARD_"), nk.cast("string")),
        "specialty_name": F.col("n_name"),
        "num_care_units": units}, "specialty_name", "specialty_name")

    ck = F.col("c_custkey")
    unit = F.concat(F.lit("CU-"), F.col("c_nationkey").cast("string"), F.lit("-"),
                    F.col("c_mktsegment"))
    batches["bed"] = _batch(customer, ck, "bed_no", {
        "bed_no": format_key("BED", ck), "care_unit_no": unit}, "care_unit_no", None)
    dob = F.date_add(F.lit("1940-01-01").cast("date"), ((ck * 37) % 20000).cast("int"))
    admitted = F.date_add(F.lit("2020-01-01").cast("date"), (ck % 365).cast("int"))
    bad = (ck % 10 == 9) & (ck % 7 == 0)
    batches["patient"] = _batch(customer, ck, "patient_no", {
        "patient_no": format_key("PAT", ck),
        "patient_name": F.col("c_name"),
        "dob": _date_text(dob, ck % 4 == 0, bad),
        "date_admitted": _date_text(admitted, ck % 5 == 0, F.lit(False)),
        "care_unit_no": unit,
        "bed_no": format_key("BED", ck)}, "patient_name", "patient_name")

    sk = F.col("s_suppkey")
    position = F.element_at(F.array(*[F.lit(p) for p in POSITION_BY_SUPPKEY_MOD6]),
                            (sk % 6 + 1).cast("int"))
    joined = F.date_add(F.lit("2010-01-01").cast("date"), (sk * 7).cast("int"))
    batches["doctor"] = _batch(supplier, sk, "staff_no", {
        "staff_no": format_key("DOC", sk),
        "name": F.col("s_name"),
        "position": F.when(sk % 5 == 0, F.lit("")).otherwise(position),
        "date_joined": _date_text(joined, sk % 4 == 0, (sk % 10 == 9) & (sk % 7 == 0)),
        "specialty_name": F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")),
        "consultant_staff_no": F.when(sk % 3 == 0, F.lit("")).otherwise(
            format_key("DOC", sk - sk % 6)),
        "is_consultant": sk % 6 == 0}, "name", "name")

    pk = F.col("p_partkey")
    role = F.lit(UNKNOWN_ROLE)
    for ptype, code in ROLE_CODE_BY_PART_TYPE.items():
        role = F.when(F.col("p_type") == ptype, F.lit(code)).otherwise(role)
    batches["nurse"] = _batch(part, pk, "staff_no", {
        "staff_no": format_key("NUR", pk),
        "name": F.col("p_name"),
        "ward_name": F.concat(F.lit("WARD_"), (pk % 25).cast("string")),
        "care_unit_no": F.concat(F.lit("CU-"), (pk % 25).cast("string"), F.lit("-"), nurse_segment()),
        "role": role}, "role", "name")
    return batches
