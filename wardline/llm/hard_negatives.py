"""Hard-negative mining with rotated one-bit codes and exact verification.

Every vector x is turned by a few seeded random rotations (sign flips and Hadamard
transforms); the signs of the turned components are its code. The code stands for a
unit vector u, and the index stores how well u is aligned with x (the cosine a).
An anchor q is turned alike and rounded to 8-bit numbers, so that <q, u> comes from
popcounts of its bit planes and the code, up to the rounding residual times the
length of the code (Cauchy-Schwarz). Since x = |x| (a u + sqrt(1 - a^2) r) with a
unit vector r at right angles to u, <q, x> lies in

    |x| (a t +- sqrt(1 - a^2) sqrt(|q|^2 - t^2)),   t = <q, u>,

for some t of that interval: a bound that holds always, not on average. Rows whose
interval cannot matter are dropped, the others are scored as integers, so results
are exact whatever the rotations are.

1. Positives: per anchor the first ``n_positives`` other rows of its label. A row
   matters unless as many rows of its block surely score higher.
2. Negatives: per anchor and positive the first ``n_negatives`` rows of other labels
   with 80 * positive_score <= 100 * negative_score <= 100 * positive_score. A row
   matters if its interval meets that range of any positive.

Both run over pairs of blocks (``vectors.Grid``) of bounded size; a block sends its
own best rows, Spark picks the best of all blocks. A label or a vector that a third
of all rows share changes nothing in how rows are dealt out.

Defined results: rows without a label, null vectors and vectors with null or
non-finite components take no part; other rules for vectors are those of
``vectors``. A null id is no anchor, keeps its label, and comes after all ids of the
same score. Rows are known by their place: repeated ids are rows of their own, and a
positive that stands twice gives its negatives twice. A negative positive_score has
no score in its range. A positive without negatives, an anchor without positives and
empty tables give no rows. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_package, written
from wardline.llm.vectors import (
    Grid,
    id_column,
    id_order,
    inner_products,
    matrix,
    store_vectors,
    take_first,
)

ANCHORS_AT_ONCE, ROWS_AT_ONCE = 64, 8192
PLANES = 8
SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 100, 7, 10


@dataclass(frozen=True)
class MiningParams:
    n_positives: int = 5
    n_negatives: int = 5
    low: int = 80        # of 100 parts of the positive's score
    rotations: int = 4   # codes have this many bits per component
    seed: int = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2)
        x, half = x.reshape(len(x), n), 2 * half
    return x / np.sqrt(n)


class Rotations:
    """Seeded rotations of vectors with ``dim`` components, continued by zeros to a
    power of two (64 at least, so that codes are whole 64-bit words)."""

    def __init__(self, dim: int, p: MiningParams):
        self.size = max(64, 1 << max(0, dim - 1).bit_length())
        signs = np.random.default_rng(p.seed).integers(0, 2, (p.rotations, 3, self.size))
        self.signs = signs * 2.0 - 1.0

    @property
    def bits(self) -> int:
        return len(self.signs) * self.size

    def turn(self, x: np.ndarray) -> np.ndarray:
        """All rotations of every row, side by side."""
        x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        parts = []
        for rounds in self.signs:
            y = x
            for flip in rounds:
                y = _hadamard(y * flip)
            parts.append(y)
        return np.concatenate(parts, axis=1)

    def back(self, y: np.ndarray) -> np.ndarray:
        """The sum of the parts of ``y``, each turned back."""
        out = np.zeros((len(y), self.size))
        for k, rounds in enumerate(self.signs):
            part = y[:, k * self.size:(k + 1) * self.size]
            for flip in rounds[::-1]:
                part = _hadamard(part) * flip
            out += part
        return out


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def codes(x: np.ndarray, turns: Rotations) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, length of the vector that the code's signs give, cosine with x)."""
    turned = turns.turn(x)
    bits = turned >= 0
    unit = turns.back(np.where(bits, 1.0, -1.0))
    length = np.sqrt((unit * unit).sum(axis=1))
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = np.abs(turned).sum(axis=1) / np.maximum(norm * length, 1e-300)
    return _words(bits), length, np.minimum(cosine, 1.0)


class AnchorCodes:
    """Anchors as 8-bit numbers in bit planes, ready for popcounts against codes."""

    def __init__(self, q: np.ndarray, turns: Rotations):
        turned = turns.turn(q)
        self.norm = np.sqrt((q * q).sum(axis=1))
        half = (1 << PLANES - 1) - 1
        self.step = np.maximum(np.abs(turned).max(axis=1, initial=0.0), 1e-300) / half
        numbers = np.rint(turned / self.step[:, None])
        residual = turned - numbers * self.step[:, None]
        self.residual = np.sqrt((residual * residual).sum(axis=1) * turns.bits)
        raised = (numbers + half).astype(np.uint8)
        self.half, self.total = half, numbers.sum(axis=1)
        self.planes = [_words((raised >> b) & 1) for b in range(PLANES)]

    def bounds(self, code: np.ndarray, length: np.ndarray, cosine: np.ndarray,
               norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products of all anchors with all rows."""
        raised = np.zeros((len(self.norm), len(code)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                raised += np.bitwise_count(plane[:, None, w] & code[None, :, w]).astype(np.int64) << b
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        signed = 2 * (raised - self.half * ones) - self.total[:, None]  # <numbers, signs>
        length = np.maximum(length, 1e-300)
        t = self.step[:, None] * signed / length
        slack = self.residual[:, None] / length + 1e-9 * self.norm[:, None]
        low, high = t - slack, t + slack
        q, rest = self.norm[:, None], np.sqrt(np.maximum(0.0, 1.0 - cosine * cosine))

        def edge(at: np.ndarray, side: float) -> np.ndarray:
            at = np.clip(at, -q, q)
            return cosine * at + side * rest * np.sqrt(np.maximum(0.0, q * q - at * at))

        # cos * t + rest * sqrt(q^2 - t^2) rises to q at t = cos * q and then falls
        upper = np.where(high < cosine * q, edge(high, 1.0),
                         np.where(low > cosine * q, edge(low, 1.0), q))
        lower = np.where(low > -cosine * q, edge(low, -1.0),
                         np.where(high < -cosine * q, edge(high, -1.0), -q))
        margin = 1e-8 * q * norm + 1e-3  # rounding of the numbers above
        return lower * norm - margin, upper * norm + margin


def build_index(df: DataFrame, p: MiningParams) -> tuple[DataFrame, int, int]:
    """(index, components, rows): the stored vectors with label, code, length and cosine."""
    stored = store_vectors(df, "embedding", SCALE, "negatives-vectors")
    n, dim = stored.agg(F.count("*"), F.max("dim")).first()  # one row
    dim = dim or 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Rotations(dim, p)
        step = max(1, (1 << 20) // turns.bits)
        for whole in batches:
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                words, length, cosine = codes(matrix(pa.Table.from_batches([batch]), dim), turns)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([w.tobytes() for w in words], pa.binary()),
                     pa.array(length), pa.array(cosine)],
                    [*batch.schema.names, "code", "length", "cosine"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    index = stored.mapInArrow(encode, f"{schema}, code binary, length double, cosine double")
    return written(index, "negatives-index"), dim, n


class _Rows:
    """The rows of a block, decoded once."""

    def __init__(self, table: pa.Table, dim: int):
        self.x = matrix(table, dim)
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.ids, self.missing = id_column(table, "vec_id")
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint64)
        self.code = code.reshape(len(table), -1) if len(table) else code.reshape(0, 1)
        self.length, self.cosine, self.norm = (
            table.column(c).to_numpy() for c in ("length", "cosine", "norm"))

    def bounds(self, anchors: AnchorCodes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return anchors.bounds(self.code[at], self.length[at], self.cosine[at], self.norm[at])


def _scored(q: np.ndarray, rows: _Rows, at: np.ndarray, survivors: np.ndarray):
    """(anchor, row, integer score) of the surviving pairs; ``at``: the rows of the columns."""
    some = np.flatnonzero(survivors.any(axis=0))
    anchor, column = np.nonzero(survivors[:, some])
    return anchor, at[some][column], inner_products(q, rows.x[at[some]])[anchor, column]


def _best(anchor, other, score, rows: _Rows, n: int):
    order = id_order(rows.ids[other], rows.missing[other], score, anchor)
    order = order[take_first(anchor[order], n)]
    return anchor[order], other[order], score[order]


def _empty() -> list[tuple[np.ndarray, ...]]:
    return [(np.zeros(0, np.int64),) * 3]


def best_of_label(anchors: pa.Table, table: pa.Table, dim: int, p: MiningParams) -> pa.Table:
    """(row, vec_id, score): per anchor the block's first rows of its label."""
    rows, q, turns = _Rows(table, dim), matrix(anchors, dim), Rotations(dim, p)
    labels, own = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
    found = _empty()
    for label in np.unique(labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(rows.label == label)
        for i in range(0, len(mine), ANCHORS_AT_ONCE):
            a = mine[i:i + ANCHORS_AT_ONCE]
            coded, best = AnchorCodes(q[a], turns), _empty()
            for j in range(0, len(theirs), ROWS_AT_ONCE):
                at = theirs[j:j + ROWS_AT_ONCE]
                lower, upper = rows.bounds(coded, at)
                itself = own[a, None] == rows.row[None, at]
                lower[itself] = -np.inf
                nth = (np.partition(lower, -p.n_positives, axis=1)[:, -p.n_positives]
                       if len(at) >= p.n_positives else np.full(len(a), -np.inf))
                picked = _scored(q[a], rows, at, (upper >= nth[:, None]) & ~itself)
                best.append(_best(*picked, rows, p.n_positives))
            anchor, other, score = _best(*(np.concatenate(x) for x in zip(*best)), rows, p.n_positives)
            found.append((a[anchor], other, score))
    anchor, other, score = (np.concatenate(x) for x in zip(*found))
    return pa.table({"row": own[anchor], "score": score, "vec_id": pa.array(
        rows.ids[other], pa.int64(), mask=rows.missing[other])})


def best_in_range(anchors: pa.Table, table: pa.Table, dim: int, p: MiningParams) -> pa.Table:
    """(row, place, vec_id, score): per anchor and positive (by its place in the
    anchor's list) the block's first rows of other labels in the positive's range."""
    rows, q, turns = _Rows(table, dim), matrix(anchors, dim), Rotations(dim, p)
    labels, own = anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
    # positives side by side; a missing one has a range that nothing meets
    high = np.full((len(q), p.n_positives), -1, np.int64)
    for a, scores in enumerate(anchors.column("scores").to_pylist()):
        high[a, :len(scores)] = scores
    found = [(np.zeros(0, np.int64),) * 4]
    for i in range(0, len(q), ANCHORS_AT_ONCE):
        some = slice(i, i + ANCHORS_AT_ONCE)
        coded, best = AnchorCodes(q[some], turns), [_empty() for _ in range(p.n_positives)]
        for j in range(0, len(rows.x), ROWS_AT_ONCE):
            at = np.arange(j, min(j + ROWS_AT_ONCE, len(rows.x)))
            lower, upper = rows.bounds(coded, at)
            meets = np.zeros(lower.shape, bool)
            for top in high[some].T:
                top = top[:, None]
                meets |= (top >= 0) & (lower <= top) & (upper * 100 >= top * float(p.low))
            meets &= labels[some, None] != rows.label[None, at]
            anchor, other, score = _scored(q[some], rows, at, meets)
            for place in range(p.n_positives):
                top = high[some][anchor, place]
                inside = (top >= 0) & (score <= top) & _at_least(score, top, p.low)
                best[place].append(_best(anchor[inside], other[inside], score[inside],
                                         rows, p.n_negatives))
        for place, parts in enumerate(best):
            anchor, other, score = _best(*(np.concatenate(x) for x in zip(*parts)), rows, p.n_negatives)
            found.append((anchor + i, np.full(len(anchor), place), other, score))
    anchor, place, other, score = (np.concatenate(x) for x in zip(*found))
    return pa.table({"row": own[anchor], "place": place.astype(np.int32), "score": score,
                     "vec_id": pa.array(rows.ids[other], pa.int64(), mask=rows.missing[other])})


def _at_least(score: np.ndarray, top: np.ndarray, low: int) -> np.ndarray:
    """low * top <= 100 * score, in parts so that no product leaves 64 bits."""
    whole, rest = np.divmod(top, 100)
    return score - low * whole >= -(-(low * rest) // 100)


def mine(df: DataFrame, is_anchor: Column, p: MiningParams = MiningParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``df`` has vec_id, label and embedding.
    """
    spark = df.sparkSession
    usable = df.where(F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        (F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("is_anchor"),
        "embedding")
    index, dim, n = build_index(usable, p)
    anchors = index.where("is_anchor").select("row", "vec_id", "label", "kind", "vec")
    rows = index.select("row", "vec_id", "label", "kind", "vec", "norm", "code", "length", "cosine")
    grid = Grid.of(anchors.count(), n, dim, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def positives(a: pa.Table, r: pa.Table) -> pa.Table:
        return best_of_label(a, r, dim, p)

    def negatives(a: pa.Table, r: pa.Table) -> pa.Table:
        return best_in_range(a, r, dim, p)

    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    firsts = grid.apply(anchors, rows, positives, "row long, score long, vec_id long").withColumn(
        "place", F.row_number().over(Window.partitionBy("row").orderBy(*order)) - 1).where(
        F.col("place") < p.n_positives)
    firsts = written(firsts, "negatives-positives")
    # at most n_positives entries per anchor
    lists = firsts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("__l"))
    armed = anchors.join(lists, "row").withColumn("scores", F.col("__l.score")).drop("__l")
    firsts = firsts.select("row", "place", F.col("vec_id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
    found = grid.apply(armed, rows, negatives, "row long, place int, score long, vec_id long")
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("row", "place").orderBy(*order))).where(F.col("rank") <= p.n_negatives)
    return (ranked.join(firsts, ["row", "place"])
            .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(
        F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % ANCHOR_EVERY == 0)


NEGATIVES_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id, embedding,
         CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT place, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM usable),
whole AS (
  SELECT place, d, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part),
anchor AS (SELECT place FROM usable WHERE vec_id % {ANCHOR_EVERY} = 0),
product AS (
  SELECT a.place AS place, c.place AS other, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM whole a JOIN anchor USING (place) JOIN whole c ON c.d = a.d AND c.place <> a.place
  GROUP BY ALL),
scored AS (
  SELECT p.place, p.score, a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike
  FROM product p JOIN usable a ON a.place = p.place JOIN usable c ON c.place = p.other),
positive AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS n
    FROM scored WHERE alike) WHERE n <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
         p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.place, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST) AS r
  FROM positive p JOIN scored s ON s.place = p.place AND NOT s.alike
    AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE r <= 5
"""
