"""The table mapping every job reads from."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.joins import bounded_broadcast
from wardline.sources.schemas import KEY_COLUMNS


def plain(df: DataFrame) -> DataFrame:
    """``df`` with plain string columns in place of collated ones."""
    return df.select([F.col(f"`{f.name}`").cast("string").alias(f.name)
                      if f.dataType.typeName() == "string" else F.col(f"`{f.name}`")
                      for f in df.schema.fields])


class Tables(Mapping[str, DataFrame]):
    """Name -> DataFrame for the 17 hospital tables.

    Jobs take a ``Tables`` so that they run unchanged on Parquet snapshots,
    a JDBC source or hand-made test rows. ``dim(name)`` returns a table
    with a broadcast hint when file or catalog statistics prove it small; the
    result of that check is remembered per table.
    """

    def __init__(self, frames: Mapping[str, DataFrame]):
        self._frames = dict(frames)
        self._dims: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_frames"][name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def dim(self, name: str, max_bytes: int | None = None) -> DataFrame:
        if name not in self._dims:
            self._dims[name] = bounded_broadcast(self._frames[name], max_bytes)
        return self._dims[name]

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every table as a temp view so SQL text can query it.

        Identifiers are case-insensitive in Spark SQL, so queries written
        against PATIENT / Patient_No resolve; the fact table is also
        registered under its long name PATIENT_TREATMENT_RECORD. Parameters
        bind with ``spark.sql(text, args={...})`` (named ``:name`` markers),
        never by string formatting.
        """
        names = []
        for name, df in self._frames.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        if "ptr" in self._frames:
            self._frames["ptr"].createOrReplaceTempView(prefix + "patient_treatment_record")
            names.append(prefix + "patient_treatment_record")
        return names

    def collated(self, collation: str) -> "Tables":
        """The tables with key and reference columns under ``collation``, for example
        UTF8_LCASE_RTRIM (upper and lower case and trailing spaces are alike).

        Joins, groupings and key checks of every job then compare them so; a value
        keeps its spelling. ``plain`` gives results plain string columns again.
        """
        return Tables({name: df.withColumns({
            c: F.collate(c, collation) for c in KEY_COLUMNS if c in df.columns
            and df.schema[c].dataType.typeName() == "string"}) for name, df in self._frames.items()})

    def replace(self, **frames: DataFrame) -> "Tables":
        merged = dict(self._frames)
        merged.update(frames)
        return Tables(merged)
