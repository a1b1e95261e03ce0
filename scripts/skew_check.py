"""Skew check: a patient, a junior doctor and a consultant each hold a third of the rows.

Usage: python scripts/skew_check.py [sf_dir]   (default /root/testdata/sf0.01)

Builds the tables, rewrites PTR so that PAT-001 and DOC-004 each own about a
third of the records and DOCTOR so that DOC-006 leads a third of the doctors,
then runs every job that meets them twice: under default settings, and planned
as if all tables were large (no broadcast; ``wardline.broadcast.maxBytes`` = 0),
both with AQE skew thresholds scaled down to this data size. For each it prints
the joins split by AQE (``skew=true``), the joins on a salted key, the largest
partition's share of the result, and whether both results are equal, by count
and sum of row hashes; only one row per partition reaches the driver.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from wardline.plans import ingest as I  # noqa: E402
from wardline.plans import records as C  # noqa: E402
from wardline.plans import reports as R  # noqa: E402
from wardline.session import local_session  # noqa: E402
from wardline.sources.batches import scenario  # noqa: E402
from wardline.sources.fixtures import build_tables  # noqa: E402

LARGE_TABLE_MODE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "wardline.broadcast.maxBytes": "0",
}
SMALL_PARTITIONS = {
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "256k",
    "spark.sql.files.openCostInBytes": "1k",
}

JOBS = {
    "q1_consultant_teams": R.q1_consultant_teams,
    "q5_unique_specialty": R.q5_unique_specialty,
    "rec_team_latest_grade": C.rec_team_latest_grade,
    "q3_patient_treatments": R.q3_patient_treatments,
    "q4_junior_patients": R.q4_junior_patients,
    "q6_treatment_experience": R.q6_treatment_experience,
    "q7_multi_complaint": R.q7_multi_complaint,
    "q8_by_complaint_treatment": R.q8_by_complaint_treatment,
    "q10_patient_full": R.q10_patient_full,
    "q11_complaint_daterange": lambda t: R.q11_complaint_daterange(
        t, "CMP-007", "1996-01-01", "1996-12-31"),
    "rec_patient_history": C.rec_patient_history,
    "rec_ward_patients": C.rec_ward_patients,
}


def run(df) -> tuple[str, list]:
    """(executed plan, (rows, sum of row hashes) per partition)."""
    parts = df.select(F.spark_partition_id().alias("p"), F.xxhash64(*df.columns).alias("h")).groupBy(
        "p").agg(F.count("h").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    rows = [(r.n, r.h) for r in parts.collect()]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        parts.explain()
    return buf.getvalue().split("== Initial Plan ==")[0], rows


def check(spark, name: str, job) -> None:
    digests = []
    for mode, settings in (("default", SMALL_PARTITIONS), ("large", SMALL_PARTITIONS | LARGE_TABLE_MODE)):
        old = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        started = time.time()
        plan, rows = run(job())
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        total = sum(n for n, _ in rows)
        digests.append((total, sum(h for _, h in rows)))
        split = [ln.split("[", 1)[1].split("]")[0] for ln in plan.splitlines() if "Join(skew=true)" in ln]
        salted = sum(1 for ln in plan.splitlines() if "Join" in ln and "__salt" in ln)
        print(f"{name:24s} {mode:8s} rows={total:>7} same={digests[0] == digests[-1]} aqe_split={split} "
              f"salted_joins={salted} largest_partition={max((n for n, _ in rows), default=0) / max(total, 1):.3f} "
              f"{time.time() - started:5.1f}s", flush=True)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(shuffle_partitions=8)
    t = build_tables(spark, sf_dir)
    bucket = F.pmod(F.crc32(F.concat_ws("|", "treatment_code", "date_started")), F.lit(3))
    ptr = t.ptr.withColumn("patient_no", F.when(bucket == 0, F.lit("PAT-001")).otherwise(
        F.col("patient_no"))).withColumn("doctor_staff_no", F.when(bucket == 1, F.lit("DOC-004"))
                                         .otherwise(F.col("doctor_staff_no")))
    third = F.pmod(F.crc32("staff_no"), F.lit(3)) == 0
    doctor = t.doctor.withColumn("consultant_staff_no", F.when(third, F.lit("DOC-006")).otherwise(
        F.col("consultant_staff_no")))
    skewed = t.replace(ptr=ptr, doctor=doctor)
    for name, job in JOBS.items():
        check(spark, name, lambda job=job: job(skewed))

    # Ingestion: a third of the patient candidates repeat one key (a storm of
    # re-posts), part of them word for word and with the same arrival number.
    _, target, batches = scenario(spark, sf_dir)
    again = F.col("arrival_seq") % 9 == 1
    cands = batches["patient"].withColumn("patient_no", F.when(again, F.lit("PAT-NEW")).otherwise(
        F.col("patient_no"))).withColumn("arrival_seq", F.when(again, F.col("arrival_seq") % 100).otherwise(
            F.col("arrival_seq")))
    check(spark, "ingest_patient", lambda: I.ingest_patient(target, cands).outcome)
    accepted = I.ingest_patient(target, cands).accepted.where("patient_no = 'PAT-NEW'").count()
    print(f"PAT-NEW accepted once: {accepted == 1}")
    spark.stop()


if __name__ == "__main__":
    main()
