"""Exact top-k search by distributed histogram selection.

Every query is scored against every other row, in blocks, several times over. A
first pass counts scores in a histogram over each query's possible range (by
Cauchy-Schwarz, from the norms); Spark adds the histograms of all blocks up and
finds the bin that holds the k-th highest score. Further passes count inside that
bin alone until it is one integer wide: the exact k-th score. The last pass keeps
the scores above it and, of those equal to it, the smallest ids still wanted.

A block sends only the bins above and including its own k-th score, and at most as
many ties as are wanted: no other bin or tie can count, so nothing is lost, and what
moves grows with blocks times k, not with rows.

Defined results: null vectors and vectors with null or non-finite components take
no part; other rules for vectors are those of ``vectors``. A row is known by its
place, not its id: rows that repeat an id or a vector are queries and candidates of
their own, a row is never its own candidate. A null id is no query; as a candidate
it comes after all ids of the same score. With fewer than k other rows all are
returned. Empty tables give no rows. Only the id and the vector column are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_package, written
from wardline.llm.vectors import (
    LIMIT,
    Grid,
    id_column,
    id_order,
    inner_products,
    matrix,
    store_vectors,
    take_first,
)

BINS = 1024
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 8192
SCALE, TOP, QUERY_EVERY = 64, 20, 20


def _score_chunks(queries: pa.Table, rows: pa.Table, dim: int):
    """(query slice, row slice, scores, own): all scores of a pair of blocks, some at
    a time; ``own`` marks a query's own row."""
    q, r = matrix(queries, dim), matrix(rows, dim)
    q_rows, r_rows = queries.column("row").to_numpy(), rows.column("row").to_numpy()
    for i in range(0, len(q), QUERIES_AT_ONCE):
        for j in range(0, len(r), ROWS_AT_ONCE):
            some = slice(i, i + QUERIES_AT_ONCE), slice(j, j + ROWS_AT_ONCE)
            yield (*some, inner_products(q[some[0]], r[some[1]]),
                   q_rows[some[0], None] == r_rows[None, some[1]])


def histograms(queries: pa.Table, rows: pa.Table, dim: int) -> pa.Table:
    """(row, bin, n): per query the counts of scores in its range, from the highest
    bin down to the one that holds its ``need``-th score of this block."""
    lo, span, need = (queries.column(c).to_numpy() for c in ("lo", "span", "need"))
    width = -(-span // BINS)
    counts = np.zeros((len(lo), BINS), np.int64)
    for qs, _, scores, own in _score_chunks(queries, rows, dim):
        place = scores - lo[qs, None]
        inside = (place >= 0) & (place < span[qs, None]) & ~own
        query, _ = np.nonzero(inside)
        bins = place[inside] // width[qs][query]
        n = inside.shape[0]
        counts[qs] += np.bincount(query * BINS + bins, minlength=n * BINS).reshape(n, BINS)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    query, bins = np.nonzero((counts > 0) & (above < need[:, None]))
    return pa.table({"row": queries.column("row").to_numpy()[query], "bin": bins.astype(np.int64),
                     "n": counts[query, bins]})


def at_or_above(queries: pa.Table, rows: pa.Table, dim: int) -> pa.Table:
    """(row, query_id, vec_id, score): scores above ``lo``, and of those equal to it
    the ``need`` smallest ids of this block."""
    lo, need = queries.column("lo").to_numpy(), queries.column("need").to_numpy()
    ids, missing = id_column(rows, "vec_id")

    def wanted(query: np.ndarray, other: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = id_order(ids[other], missing[other], score, query)
        query, other, score = query[order], other[order], score[order]
        tie = score == lo[query]
        keep = ~tie
        keep[tie] = take_first(query[tie], need[query[tie]])
        return query[keep], other[keep], score[keep]

    picked = [(np.zeros(0, np.int64),) * 3]
    for qs, rs, scores, own in _score_chunks(queries, rows, dim):
        query, other = np.nonzero((scores >= lo[qs, None]) & ~own)
        picked.append(wanted(query + qs.start, other + rs.start, scores[query, other]))
    query, other, score = wanted(*(np.concatenate(x) for x in zip(*picked)))
    return pa.table({
        "row": queries.column("row").to_numpy()[query],
        "query_id": queries.column("vec_id").to_numpy()[query],
        "vec_id": pa.array(ids[other], pa.int64(), mask=missing[other]), "score": score})


def kth_scores(queries: DataFrame, rows: DataFrame, grid: Grid, dim: int, reach: int) -> DataFrame:
    """``queries`` with ``lo`` (the k-th highest score) and ``need`` (how many of the
    scores equal to it belong to the top k). ``reach`` bounds the size of any score."""

    def count(q: pa.Table, r: pa.Table) -> pa.Table:
        return histograms(q, r, dim)

    span = 2 * reach + 1
    while True:
        per_bin = grid.apply(queries, rows, count, "row long, bin long, n long").groupBy(
            "row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("row").orderBy(F.desc("bin")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        reached = per_bin.withColumn("__sum", F.sum("n").over(down)).select(
            "row", "bin", "__sum", (F.col("__sum") - F.col("n")).alias("__above"))
        found = queries.select("row", "need").join(reached, "row").where(
            (F.col("__sum") >= F.col("need")) & (F.col("__above") < F.col("need"))).select(
            "row", "bin", "__above")
        width = F.expr(f"(span + {BINS - 1}) div {BINS}")
        none = F.col("bin").isNull()  # fewer scores than wanted: all of them are
        queries = written(
            queries.join(found, "row", "left")
            .withColumn("need", F.when(none, F.lit(0)).otherwise(F.col("need") - F.col("__above")))
            .withColumn("lo", F.when(none, F.lit(-LIMIT - 1)).otherwise(
                F.col("lo") + F.col("bin") * width))
            .withColumn("span", F.when(none, F.lit(1)).otherwise(width))
            .drop("bin", "__above"), "topk-state")
        span = max(1, -(-span // BINS))
        if span == 1:
            return queries


def top_k(df: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` its k highest
    inner products with all other rows, ties by smaller id."""
    spark = df.sparkSession
    marked = df.select(F.col(vec_id).cast("long").alias("vec_id"),
                       (F.coalesce(is_query, F.lit(False)) & F.col(vec_id).isNotNull()).alias("is_query"),
                       F.col(vector).alias("embedding"))
    rows = store_vectors(marked, "embedding", scale, "topk-rows")
    n, n_queries, dim, norm = rows.agg(  # one row of sums and maxima
        F.count("*"), F.count_if("is_query"), F.max("dim"), F.max("norm")).first()
    dim, norm = dim or 0, norm or 0.0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = Grid.of(n_queries, n, dim, tasks)
    reach = min(LIMIT, math.ceil(min(norm * norm * (1 + 1e-9), float(LIMIT))) + 1)
    bound = F.least(F.lit(float(LIMIT)), F.ceil(F.col("norm") * (norm * (1 + 1e-9))).cast("double") + 1)
    queries = rows.where("is_query").select(
        "row", "vec_id", "kind", "vec", (-bound.cast("long")).alias("lo"),
        (2 * bound.cast("long") + 1).alias("span"), F.lit(k).cast("long").alias("need"))
    rows = rows.select("row", "vec_id", "kind", "vec")
    queries = kth_scores(queries, rows, grid, dim, reach)

    def keep(q: pa.Table, r: pa.Table) -> pa.Table:
        return at_or_above(q, r, dim)

    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (grid.apply(queries, rows, keep, "row long, query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


# Rows are numbered, so that repeated ids stay apart; a vector with a null or
# non-finite component is left out as a whole.
TOPK_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT place, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM usable),
whole AS (
  SELECT place, vec_id, d, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part),
scored AS (
  SELECT q.place AS place, q.vec_id AS query_id, c.place AS other, c.vec_id AS vec_id,
         CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.d = q.d AND c.place <> q.place
  WHERE q.vec_id % {QUERY_EVERY} = 0
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS r
  FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {TOP}
"""
