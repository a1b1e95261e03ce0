"""Sources and sinks: Parquet snapshots (explicit schemas), JSON, JDBC.

Snapshots are immutable directories: a job reads one snapshot and writes a
new one, so an input is never overwritten while it is being read.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.sources.catalog import Tables
from wardline.sources.schemas import KEY_COLUMNS, SCHEMAS

# Files of the fact table are range-partitioned and sorted by start date, so
# Parquet min/max statistics prune whole files / row groups for date ranges.
# The patient number lets a range split a day with very many equal complaints.
FACT_LAYOUT = {"ptr": ["date_started", "complaint_code", "patient_no"]}
# Upper bound on rows per output file (a few hundred MB of fact rows), so a
# large range partition becomes several files instead of one huge one.
MAX_RECORDS_PER_FILE = 5_000_000


def save_tables(tables: Tables, path: str, files_per_table: int | None = None,
                concurrent_jobs: int = 4) -> None:
    """Write every table to ``path/<name>`` (fails if a snapshot exists).

    The tables are independent, so their write jobs are submitted from a few
    driver threads at once and share the executors instead of queueing.
    """

    def write(name: str) -> None:
        df = tables[name]
        layout = FACT_LAYOUT.get(name)
        if layout:
            n = files_per_table or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            df = df.repartitionByRange(n, *layout).sortWithinPartitions(*layout)
        df.write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(
            f"{path}/{name}")

    # Largest first so the fact table does not start last.
    order = sorted(tables, key=lambda n: n not in FACT_LAYOUT)
    with ThreadPoolExecutor(max_workers=max(1, concurrent_jobs)) as pool:
        for future in [pool.submit(write, name) for name in order]:
            future.result()


def load_tables(spark: SparkSession, path: str, names: Iterable[str] = tuple(SCHEMAS)) -> Tables:
    """Read a snapshot written by ``save_tables`` with the declared schemas."""
    return Tables({name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in names})


V1_SOURCES = "spark.sql.sources.useV1SourceList"


def load_counted(spark: SparkSession, path: str, names: Iterable[str] = tuple(SCHEMAS)) -> Tables:
    """A snapshot read through Spark's V2 Parquet source, which answers counts, minima
    and maxima without a filter from the file footers (``spark.sql.parquet.
    aggregatePushdown``, set by ``session.tune``). For ``listings.dash_totals`` this
    reads a few kilobytes per file; other jobs read the same rows as from ``load_tables``.
    """
    before = spark.conf.get(V1_SOURCES)
    # the choice is made when a path is loaded, so it holds for these tables alone
    spark.conf.set(V1_SOURCES, ",".join(x for x in before.split(",") if x.strip() != "parquet"))
    try:
        return load_tables(spark, path, names)
    finally:
        spark.conf.set(V1_SOURCES, before)


MONTH = "start_month"


def month_of(date: Column) -> Column:
    """yyyymm as a number, the partition of a treatment record; NULL without a date."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def save_monthly_facts(ptr: DataFrame, path: str) -> None:
    """PTR in one directory per month of its start date, sorted inside.

    Rows of a month go to several tasks by patient, so that a month with a large share
    of all rows is written by many.
    """
    rows = ptr.withColumn(MONTH, month_of(F.col("date_started")))
    parts = int(ptr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartitionByRange(parts, MONTH, "date_started", "patient_no")
     .sortWithinPartitions(MONTH, "date_started", "complaint_code")
     .write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy(MONTH).parquet(path))


def load_monthly_facts(spark: SparkSession, path: str) -> DataFrame:
    """PTR as saved by month; jobs with a date range read its months alone."""
    schema = T.StructType([*SCHEMAS["ptr"].fields, T.StructField(MONTH, T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new Parquet snapshot directory; refuses to overwrite."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """JSON lines, dates as yyyy-MM-dd (the reference's date text)."""
    writer = df.write.mode("errorifexists").option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON object; the rows of a key are not gathered."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"dateFormat": "yyyy-MM-dd"}).alias("json"))


def export_text(df: DataFrame) -> DataFrame:
    """Dates rendered as yyyy-MM-dd strings, as the reference prints them."""
    return df.select([
        F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
        if f.dataType.typeName() == "date" else F.col(f.name)
        for f in df.schema.fields])


def read_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
              table_names: dict[str, str] | None = None,
              partitioning: dict[str, tuple[str, str, str, int]] | None = None) -> Tables:
    """Load the 17 tables through Spark's JDBC source (driver jar required).

    ``table_names`` maps our table names to the database's (default: upper
    case, PATIENT_TREATMENT_RECORD for ptr). ``partitioning`` gives, per table,
    (column, lower bound, upper bound, partitions) of a numeric or date column,
    so that a large table is read by that many tasks and connections at once;
    a table without an entry is read by one. Columns are lower-cased and cast
    to the declared schema.
    """
    names = {n: n.upper() for n in SCHEMAS}
    names["ptr"] = "PATIENT_TREATMENT_RECORD"
    names.update(table_names or {})
    frames = {}
    for name, schema in SCHEMAS.items():
        reader = spark.read.format("jdbc").options(url=url, dbtable=names[name], **properties)
        if name in (partitioning or {}):
            column, lower, upper, parts = partitioning[name]
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper,
                                    numPartitions=str(parts))
        raw = reader.load()
        raw = raw.toDF(*[c.lower() for c in raw.columns])
        frames[name] = raw.select([F.col(f.name).cast(f.dataType).alias(f.name)
                                   for f in schema.fields])
    return Tables(frames)


# Bucketed layout for a catalog deployment: tables joined or grouped on the
# same key share a bucket count, so those joins and aggregations read
# co-located buckets and never shuffle the fact table on that key.
# PTR <-> PATIENT on patient_no (Q3, Q7, Q8, Q10, Q11, record extracts);
# DOCTOR <-> PROGRESS / PREVIOUS_EXPERIENCE on staff_no (Q6, Q9, team grades).
BUCKET_KEYS = {
    "ptr": "patient_no",
    "patient": "patient_no",
    "doctor": "staff_no",
    "progress": "staff_no",
    "previous_experience": "staff_no",
}


def save_bucketed(tables: Tables, database: str, buckets: int, analyze: bool = True,
                  location: str | None = None) -> None:
    """Save all tables into catalog ``database`` (below ``location``, default the
    warehouse); the BUCKET_KEYS tables bucketed and sorted by their key into
    ``buckets`` buckets.

    With ``analyze`` the catalog also gets row counts, sizes and, for the columns that
    jobs join and filter on, distinct counts and bounds (ANALYZE TABLE), so that
    ``session.use_statistics`` can plan joins and their order from them.
    """
    spark = next(iter(tables.values())).sparkSession
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, df in tables.items():
        key = BUCKET_KEYS.get(name)
        if key:  # one task per bucket, so a bucket is not scattered over one file per task
            df = df.repartition(buckets, key)
        writer = df.write.mode("errorifexists").format("parquet").option(
            "maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{database}.{name}")
        if analyze:
            columns = [f.name for f in SCHEMAS[name].fields
                       if f.name in KEY_COLUMNS or f.dataType.typeName() == "date"]
            spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS"
                      f" FOR COLUMNS {', '.join(columns)}")


def load_catalog(spark: SparkSession, database: str, names: Iterable[str] = tuple(SCHEMAS)) -> Tables:
    """Tables saved by ``save_bucketed`` (bucket metadata comes from the catalog)."""
    return Tables({name: spark.table(f"{database}.{name}").select(
        [F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields]) for name in names})
