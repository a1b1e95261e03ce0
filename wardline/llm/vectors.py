"""Integer vectors shared by the search operators: scaling, exact inner products, blocks.

A component x is stored as floor(scale * x). Vectors that are null or hold a null
or a component that is not finite (before or after scaling) are left out; a vector
without components stays. Where lengths differ, the shorter vector counts as
continued by zeros. Scores are exact integers; one beyond ``LIMIT`` in size is
given as ``LIMIT`` with its sign, so that every score fits its column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.deploy import written

LIMIT = 1 << 61
SLICE_VALUES = 1 << 20       # components handled at a time while vectors are stored
QUERY_BYTES = 8 << 20        # query vectors of a block, as 8-byte numbers
ROW_BYTES = 32 << 20         # candidate vectors of a block, as 8-byte numbers
QUERY_ROWS, ROW_ROWS, SPREAD_ROWS = 2048, 65536, 64
KINDS = (np.int8, np.int16, np.int32, np.float64)  # how a vector's bytes are to be read


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row; rows may be empty."""
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values[:offsets[-1]], offsets[full])
    return out


def _scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, their integer components, offsets of the kept rows)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)  # a null component has become NaN
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    odd = row_sums((~np.isfinite(values)).astype(np.float64), offsets)
    kept = pc.is_valid(column).to_numpy(zero_copy_only=False) & (odd == 0)
    values = values[np.repeat(kept, lengths)]
    return np.flatnonzero(kept), values, np.concatenate(([0], np.cumsum(lengths[kept], dtype=np.int64)))


def store_vectors(df: DataFrame, vector: str, scale: float, name: str) -> DataFrame:
    """Write the usable rows of ``df``: its other columns, and

    ``row`` (a number of its own for every row), ``kind`` and ``vec`` (the integer
    components as bytes), ``dim``, ``peak`` (largest component by size), ``norm``.
    """
    others = [c for c in df.columns if c != vector]
    names = [*others, "kind", "vec", "dim", "peak", "norm"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
                        if f.name != vector])
    schema += ", kind int, vec binary, dim int, peak double, norm double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            width = max(1, len(pc.list_flatten(whole.column(vector))) // max(1, len(whole)))
            step = max(1, SLICE_VALUES // width)
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                kept, values, offsets = _scaled(batch.column(vector), scale)
                if not len(kept):
                    continue
                size = np.abs(values)
                kind = int(np.searchsorted([127, 32767, 2147483647], size.max(initial=0)))
                data = values.astype(KINDS[kind])
                peak = np.zeros(len(kept))
                full = np.flatnonzero(np.diff(offsets))
                if len(full):
                    peak[full] = np.maximum.reduceat(size, offsets[full])
                vec = pa.Array.from_buffers(pa.binary(), len(kept), [
                    None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)),
                    pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(kept)) for c in others]
                    + [pa.array(np.full(len(kept), kind, np.int32)), vec,
                       pa.array(np.diff(offsets).astype(np.int32)), pa.array(peak),
                       pa.array(np.sqrt(row_sums(values * values, offsets)))], names)

    stored = df.select(*others, vector).mapInArrow(run, schema)
    return written(stored.withColumn("row", F.monotonically_increasing_id()), name)


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    """The vectors of ``table`` as rows of 8-byte numbers, zeros behind shorter ones."""
    out = np.zeros((len(table), dim))
    kinds = table.column("kind").to_numpy()
    column = table.column("vec").combine_chunks()
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        vecs = column.take(pa.array(at))
        lengths = pc.binary_length(vecs).to_numpy(zero_copy_only=False) // np.dtype(KINDS[kind]).itemsize
        values = np.frombuffer(b"".join(vecs.to_pylist()), KINDS[kind])
        out[np.repeat(at, lengths),
            np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``q`` with all rows of ``c``."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if bound < 1 << 24:  # every partial sum is exact in single precision
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(c).T if q.size and c.size else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def id_order(ids: np.ndarray, missing: np.ndarray, score: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order by group, highest score, smallest id, missing ids last."""
    return np.lexsort((ids, missing, -score, group))


def take_first(group: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Mask of the first ``n`` (one number, or one per row) rows of each run of equal groups."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group)))) < n


def id_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing) of a column of nullable integers."""
    column = table.column(name).combine_chunks()
    return (pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64),
            pc.is_null(column).to_numpy(zero_copy_only=False))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


@dataclass(frozen=True)
class Grid:
    """Query blocks against row blocks: each pair of blocks is one group of bounded size.

    Every query goes to the ``row_blocks`` groups of its query block, every row to
    the ``query_blocks`` groups of its row block, so a group's memory depends on the
    block sizes alone and every query meets every row exactly once.
    """

    query_blocks: int
    row_blocks: int

    @staticmethod
    def of(n_queries: int, n_rows: int, dim: int, tasks: int) -> "Grid":
        width = 8 * max(1, dim)
        queries = -(-n_queries // max(1, min(QUERY_ROWS, QUERY_BYTES // width)))
        rows = -(-n_rows // max(1, min(ROW_ROWS, ROW_BYTES // width)))
        spread = min(-(-tasks // max(1, queries)), -(-n_rows // SPREAD_ROWS))  # work for every task
        return Grid(max(1, queries), max(1, rows, spread))

    def apply(self, queries: DataFrame, rows: DataFrame,
              work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work(queries of a block, rows of a block)`` for all pairs of blocks."""
        queries = queries.toDF(*queries.columns)  # columns of its own beside those of ``rows``
        q = queries.withColumn("__q", F.pmod(F.xxhash64("row"), F.lit(self.query_blocks))).withColumn(
            "__r", F.explode(_numbers(self.row_blocks)))
        r = rows.withColumn("__r", F.pmod(F.xxhash64("row"), F.lit(self.row_blocks))).withColumn(
            "__q", F.explode(_numbers(self.query_blocks)))
        parts = min(self.query_blocks * self.row_blocks, 1 << 17)
        left = q.repartition(parts, "__q", "__r").groupBy("__q", "__r")
        right = r.repartition(parts, "__q", "__r").groupBy("__q", "__r")
        return left.cogroup(right).applyInArrow(work, schema)
