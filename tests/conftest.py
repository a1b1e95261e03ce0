from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from wardline.session import tune  # noqa: E402
from wardline.sources.catalog import Tables  # noqa: E402
from wardline.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("wardline-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wardline-test-ckpt-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="wardline-test-wh-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def d(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture
def make_tables(spark):
    """Tables from row tuples per table name; unspecified tables are empty."""

    def build(**rows) -> Tables:
        return Tables({
            name: spark.createDataFrame(rows.get(name, []), schema)
            for name, schema in SCHEMAS.items()
        })

    return build


def collect(df, *cols):
    rows = df.select(*cols).collect() if cols else df.collect()
    return [tuple(r) for r in rows]
