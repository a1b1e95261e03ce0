"""Quality classifier: hashed word n-gram logistic regression, FTRL-trained.

Features of a text are its tokens (runs of letters, digits and non-ASCII
bytes, and runs of ASCII punctuation between separators) and token pairs,
hashed into ``2**bits`` bins (a token paired with
itself is one feature, whatever the token); a text with n features gives each occurrence the
value 1/sqrt(n). The model is fitted by FTRL-proximal (per-coordinate steps,
L1 and L2) on a bounded sample of labelled rows and scored as a sparse dot
product in the scan, so no text is shuffled.

Defined results: a null or empty text has no features and scores the bias
alone. A null doc_id is scored and never held out. Repeated rows give one
result row each. Labels that are null or not 0/1 are ignored; a doc_id with
several labels counts as 1 if any is 1. Without usable labels (or with an
empty table) the model is empty and every score is 0.5. Only ``doc_id`` and
``text`` (``quality`` for labels) are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_package
from wardline.llm.textblocks import TextBlock, mix, text_blocks, window_hashes

FOLDS = 5


@dataclass(frozen=True)
class ClassifierParams:
    bits: int = 18
    sample_rows: int = 16_000  # bound on the labelled rows used for fitting
    shards: int = 4            # FTRL runs whose weights are averaged
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    threshold: float = 0.3


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True
_REPEAT_BIN = 0
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(block: TextBlock, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every feature, offsets per text): all tokens, then pairs, by text."""
    data, n = block.data, len(block.data)
    kind = np.where(_SPACE[data], 0, np.where(_PUNCTUATION[data], 2, 1)).astype(np.int8)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    edge[n:] = True
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    hashes = mix(block.span_hash(block.prefix_hash(), starts, ends))
    first = np.searchsorted(starts, block.offsets)
    shift = np.uint64(64 - bits)
    single = (hashes >> shift).astype(np.int64)
    pair = (window_hashes(hashes, 2) >> shift).astype(np.int64)
    pair[hashes[1:] == hashes[:-1]] = _REPEAT_BIN  # "the the": one feature for any token
    counts = np.diff(first)
    inside = np.ones(len(pair), bool)  # pairs whose two tokens are of one text
    inner = first[1:-1]
    inside[inner[(inner > 0) & (inner <= len(pair))] - 1] = False
    owner = np.repeat(np.arange(len(counts)), counts)
    owners = np.concatenate((owner, owner[:len(pair)][inside]))
    order = np.argsort(owners, kind="stable")
    bins = np.concatenate((single, pair[inside]))[order]
    return bins, np.searchsorted(owners[order], np.arange(len(counts) + 1))


def score_block(block: TextBlock, weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability of label 1 per text; ``weights[-1]`` is the bias."""
    bins, offsets = features(block, bits)
    sums = np.concatenate(([0.0], np.cumsum(weights[bins], dtype=np.float64)))
    n = np.maximum(np.diff(offsets), 1)
    margin = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(n) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def ftrl(examples: list[tuple[np.ndarray, float]], p: ClassifierParams) -> np.ndarray:
    """Follow-the-regularised-leader updates over the examples, in order."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights_at(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        shrunk = np.sign(zi) * p.l1 - zi
        return np.where(np.abs(zi) <= p.l1, 0.0,
                        shrunk / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for bins, label in examples:
            i, counts = np.unique(bins, return_counts=True)
            x = np.append(counts / np.sqrt(max(len(bins), 1)), 1.0)
            i = np.append(i, size - 1)
            w = weights_at(i)
            guess = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0)))
            g = (guess - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights_at(np.arange(size))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that never take part in fitting."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: ClassifierParams) -> DataFrame:
    """(doc_id, text, label): the ``sample_rows`` labelled rows with the smallest
    hash of doc_id, none of them held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = (usable.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows))
    # at most sample_rows pairs of numbers, whatever the tables hold
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, p: ClassifierParams = ClassifierParams()) -> np.ndarray:
    """Weights (2**bits bins and the bias): the mean of ``shards`` FTRL runs."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("doc_id"), batch.column("label")
            for block in text_blocks(batch.column("text")):
                bins, offsets = features(block, p.bits)
                bins = bins.astype(np.int32)
                parts = [bins[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, len(block)), label.slice(block.first, len(block)),
                     pa.array(parts, pa.binary())], ["doc_id", "label", "bins"])

    def run_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "doc_id"])
        examples = [(np.frombuffer(b, np.int32), float(y))
                    for b, y in zip(rows["bins"], rows["label"])]
        return pd.DataFrame({"weights": [ftrl(examples, p).astype(np.float32).tobytes()]})

    sample = training_rows(docs, labels, p).mapInArrow(
        extract, "doc_id long, label int, bins binary")
    shards = (sample.withColumn("rank", F.xxhash64("doc_id", F.lit(1)))
              .withColumn("shard", F.pmod("rank", F.lit(p.shards)))
              .groupBy("shard").applyInPandas(run_shard, "weights binary"))
    models = [np.frombuffer(r.weights, np.float32) for r in shards.collect()]  # shards rows
    if not models:
        return np.zeros((1 << p.bits) + 1, np.float32)
    return np.mean(models, axis=0, dtype=np.float64).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray,
          p: ClassifierParams = ClassifierParams()) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the model travels as 1 MB of closure."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_block(b, weights, p.bits) for b in text_blocks(batch.column("text"))]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(flat, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double")


def classify(docs: DataFrame, labels: DataFrame,
             p: ClassifierParams = ClassifierParams()) -> DataFrame:
    """Fit on ``labels`` and score every document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, p), p)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame,
              p: ClassifierParams = ClassifierParams()) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier accepts.

    The verdict is computed next to the row in the same scan, so rows with a
    null or repeated doc_id are judged by their own text and nothing is joined.
    """
    weights = fit(docs, labels, p)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_block(b, weights, p.bits) for b in text_blocks(batch.column(at))]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield batch.filter(pa.array(flat >= p.threshold))

    at = names.index("text")
    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels)
