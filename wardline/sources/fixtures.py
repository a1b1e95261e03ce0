"""Map the driver's TPC-H-style test tables onto the hospital model.

The reference ships no data, so the 17 tables are derived from
``/root/testdata/sf*/`` by fixed rules (FIXTURES.md §2). Every rule is a
column expression or a keyed join, so the derived tables grow with the
source and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.columns import format_key
from wardline.operators.joins import bounded_broadcast
from wardline.sources.catalog import Tables
from wardline.sources.schemas import SCHEMAS

SOURCE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed values of the mapping (FIXTURES.md §2).
MARKET_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
POSITION_BY_SUPPKEY_MOD6 = (
    "consultant",
    "registrar(r)",
    "assistant registrar(ar)",
    "senior houseman(sh)",
    "junior houseman(jh)",
    "student(s)",
)
ROLE_BY_PART_TYPE = {
    "day_sister": ("ECONOMY",),
    "night_sister": ("LARGE",),
    "staff_nurse": ("MEDIUM", "PROMO"),
    "non_reg_nurse": ("SMALL",),
}
DOB_BASE, JOINED_BASE = "1940-01-01", "2010-01-01"
GRADE_FLOORS = (("A", 100.0), ("B", 50.0), ("C", 20.0))  # else 'D'
# Every tenth event is an employment, the others are progress reports.
EXPERIENCE_EVERY = 10

# Declared, so that reading the sources starts no schema-inference job.
SOURCE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
              " props string",
}


def read_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
            for name in SOURCE_TABLES}


def nurse_segment() -> F.Column:
    """The market segment that names a nurse's care unit: by part size modulo 5."""
    return F.element_at(F.array(*[F.lit(s) for s in MARKET_SEGMENTS]), F.col("p_size") % 5 + 1)


def _unit_no(nation_key, segment) -> F.Column:
    return F.concat(F.lit("CU-"), nation_key.cast("string"), F.lit("-"), segment)


def _ward_name(nation_key) -> F.Column:
    return F.concat(F.lit("WARD_"), nation_key.cast("string"))


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast to the declared schema, in declared column order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def build_tables(spark: SparkSession, sf_dir: str) -> Tables:
    src = read_sources(spark, sf_dir)
    nation, customer, supplier = src["nation"], src["customer"], src["supplier"]
    part, orders, lineitem, events = src["part"], src["orders"], src["lineitem"], src["events"]
    nations = bounded_broadcast(nation.select("n_nationkey", "n_name"))

    t: dict[str, DataFrame] = {}
    t["specialty"] = nation.select(F.col("n_name").alias("specialty_name"))
    t["complaint"] = nation.select(
        format_key("CMP", F.col("n_nationkey")).alias("complaint_code"),
        F.col("n_name").alias("description"))

    ward_spec = nations.select(F.col("n_nationkey").alias("spec_key"),
                               F.col("n_name").alias("specialty_name"))
    t["ward"] = (
        nation.select(_ward_name(F.col("n_nationkey")).alias("ward_name"),
                      (F.col("n_nationkey") % 20).alias("spec_key"))
        .join(ward_spec, "spec_key", "left")
        .withColumn("number_of_care_units", F.lit(5)))

    cust_unit = _unit_no(F.col("c_nationkey"), F.col("c_mktsegment"))
    t["care_unit"] = customer.select(
        cust_unit.alias("care_unit_no"), _ward_name(F.col("c_nationkey")).alias("ward_name")
    ).distinct()
    t["bed"] = customer.select(
        format_key("BED", F.col("c_custkey")).alias("bed_no"),
        cust_unit.alias("care_unit_no"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).alias("is_occupied"))

    first_order = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("date_admitted"))
    t["patient"] = customer.join(first_order, "c_custkey", "left").select(
        format_key("PAT", F.col("c_custkey")).alias("patient_no"),
        F.col("c_name").alias("patient_name"),
        F.date_add(F.lit(DOB_BASE).cast("date"),
                   ((F.col("c_custkey") * 37) % 20000).cast("int")).alias("date_of_birth"),
        "date_admitted",
        cust_unit.alias("care_unit_no"),
        format_key("BED", F.col("c_custkey")).alias("bed_no"))

    k = F.col("s_suppkey")
    position = F.element_at(F.array(*[F.lit(p) for p in POSITION_BY_SUPPKEY_MOD6]),
                            (k % 6 + 1).cast("int"))
    t["doctor"] = supplier.join(
        nations.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "left"
    ).select(
        format_key("DOC", k).alias("staff_no"),
        F.col("s_name").alias("name"),
        position.alias("position"),
        F.when(k % 10 == 9, F.lit(None)).otherwise(
            F.date_add(F.lit(JOINED_BASE).cast("date"), (k * 7).cast("int"))).alias("date_joined_team"),
        F.col("n_name").alias("specialty_name"),
        F.when(k % 12 == 6, F.lit(None)).otherwise(format_key("DOC", k - k % 6)).alias("consultant_staff_no"))
    t["consultant"] = supplier.where(k % 6 == 0).select(format_key("DOC", k).alias("staff_no"))

    pk = F.col("p_partkey")
    t["nurse"] = part.select(
        format_key("NUR", pk).alias("staff_no"),
        F.col("p_name").alias("name"),
        _ward_name(pk % 25).alias("ward_name"),
        _unit_no(pk % 25, nurse_segment()).alias("care_unit_no"))
    for role, types in ROLE_BY_PART_TYPE.items():
        t[role] = part.where(F.col("p_type").isin(*types)).select(
            format_key("NUR", pk).alias("staff_no"))

    t["treatment"] = part.select(format_key("TRT", pk).alias("treatment_code"),
                                 F.col("p_name").alias("description"))

    started = F.col("l_shipdate").cast("date")
    t["ptr"] = lineitem.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    ).select(
        format_key("PAT", F.col("o_custkey")).alias("patient_no"),
        format_key("CMP", F.col("l_orderkey") % 25).alias("complaint_code"),
        format_key("TRT", F.col("l_partkey")).alias("treatment_code"),
        format_key("DOC", F.col("l_suppkey")).alias("doctor_staff_no"),
        started.alias("date_started"),
        F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise(
            F.date_add(started, F.col("l_quantity").cast("int"))).alias("date_ended"))

    ev_date = F.col("ts").cast("date")
    establishment = F.concat(F.lit("EST-"), (F.col("event_id") % 7).cast("string"))
    # Events of users who are no doctors stay: the queries look the doctor up.
    t["previous_experience"] = events.where(F.col("event_id") % EXPERIENCE_EVERY == 0).select(
        F.col("event_id").alias("exp_id"),
        format_key("DOC", F.col("user_id")).alias("staff_no"),
        ev_date.alias("from_date"),
        F.date_add(ev_date, F.floor("value").cast("int")).alias("to_date"),
        establishment.alias("establishment"),
        F.col("event_type").alias("position"))

    grade = F.lit("D")
    for letter, floor in reversed(GRADE_FLOORS):
        grade = F.when(F.col("value") >= floor, F.lit(letter)).otherwise(grade)
    t["progress"] = events.where(F.col("event_id") % EXPERIENCE_EVERY != 0).select(
        F.col("event_id").alias("progress_id"),
        format_key("DOC", F.col("user_id")).alias("staff_no"),
        establishment.alias("establishment"),
        F.col("event_type").alias("position"),
        ev_date.alias("date"),
        grade.alias("performance_grade"))

    return Tables({name: _conform(t[name], name) for name in SCHEMAS})
