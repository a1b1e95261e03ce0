"""Tables kept in hash partitions of their key, so that a batch rewrites few of them.

A plain snapshot is written whole for every batch. Here the rows of a table lie in
``parts`` directories by a hash of the key, and a batch replaces only the directories
that hold a changed key (dynamic partition overwrite); files of the others stay as
they are. Spark stages the new files of a write and moves them in when the job
commits, and a partition is rewritten from its own rows, so a job that ends early
leaves old or new partitions, which the same call brings up to date when repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "key_part"


@dataclass(frozen=True)
class PartitionedTable:
    """A Parquet table at ``path`` with ``schema``, in ``parts`` partitions by ``key``.

    The key is hashed byte by byte, so collated keys are refused.
    """

    path: str
    schema: T.StructType
    key: str
    parts: int

    def __post_init__(self) -> None:
        kind = self.schema[self.key].dataType
        if isinstance(kind, T.StringType) and kind != T.StringType():
            raise ValueError(f"{self.key} is collated; partitions need a key compared byte by byte")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        names = [f.name for f in self.schema.fields]
        # one task per partition, so a partition is one file (or few large ones)
        (df.select(*names, self._part().alias(PART)).repartition(self.parts, PART)
         .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path))

    def save(self, df: DataFrame) -> None:
        """Store the first version (fails if the path exists)."""
        self._write(df, "errorifexists")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])
                                 ).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(PART)

    def replace(self, changed: DataFrame, build: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the partitions of the keys in ``changed`` with ``build(their rows)``.

        ``build`` must return rows of those partitions only. Returns their numbers
        (at most ``parts``).
        """
        spark = changed.sparkSession
        touched = [r[0] for r in changed.select(self._part()).distinct().collect()]
        if touched:
            old = self._stored(spark).where(F.col(PART).isin(touched)).drop(PART)
            self._write(build(old), "overwrite")
        return sorted(touched)
