"""Language-model scoring: stupid backoff over corpus-wide n-gram counts.

A word is scored by the longest context that other documents confirm:
c(context word) / c(context) if that n-gram occurs outside the document, else
``backoff`` times the score with a shorter context; an unseen word ends at
``backoff**order / N``. All counts leave the scored document out, so a text
does not confirm itself. A document's score is the sum of its words' logarithms.

The work is relational. Documents are dealt into blocks and exploded into rows
(block, n-gram hash, occurrences in the block), shuffled once by hash: one aggregate
makes the count table, one join on the same partitioning gives every block the
corpus-wide counts of its n-grams. An n-gram that stands in one block only has its
count there already and is not sent back. This is done for one part of the hashes after
another (``PARTS``), so that the rows of one part only are on disk; the counts of each part
are stored packed, a row per block and batch of joined rows. A block's documents meet their
counts in a cogroup by block and sum their words' scores. A hot n-gram is one row per block,
and a task holds one block of about ``BLOCK_CHARS`` characters (a longer text is a block
with the texts dealt to it), whatever the size of the corpus.

Words are runs of bytes other than space and ``\\t``..``\\r``, ASCII
lower-cased; n-grams do not cross documents and are compared by 64-bit hash.

Defined results: null or empty texts have no words: score 0, mean null. A
null doc_id is scored like any other. Rows that repeat a doc_id are separate
documents and do confirm each other. A corpus of one document scores every
word as unseen (N counted as at least 1). An empty table gives an empty
result. Texts are read whole, however long. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_package, written
from wardline.llm.textblocks import (binary_array, pack_integers, text_blocks, unpack_integers,
                                      window_hashes, word_hashes)
from wardline.session import size_shuffles

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 12_000_000
ROW_BYTES = 10  # n-gram rows take about so many times the bytes of their text
PART_BITS = 2
PARTS = 1 << PART_BITS  # n-grams are counted in so many steps, by the top bits of the hash
HELD_ROWS = 1 << 20  # joined rows packed at a time
CORPUS = 0  # the hash of the row that counts a block's words; n-grams have odd hashes


def ngrams(hashes: np.ndarray, word_offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Per length 1..order: the hash of the n-gram that ends at each word, 0 where the
    text has too few words before it."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(word_offsets[:-1], np.diff(word_offsets))
    out = []
    for length in range(1, order + 1):
        at = np.zeros(n, np.uint64)
        if n >= length:
            at[length - 1:] = window_hashes(hashes, length) | np.uint64(1)
        at[place < length - 1] = 0
        out.append(at)
    return out


def _block_grams(column: pa.Array, order: int):
    """(hashes of all n-grams of a block, per length; words per text)."""
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts = []
    for block in text_blocks(column):
        hashes, word_offsets = word_hashes(block.lower())
        for out, found in zip(parts, ngrams(hashes, word_offsets, order)):
            out.append(found)
        counts.append(np.diff(word_offsets))
    empty = np.zeros(0, np.uint64)
    return ([np.concatenate(p) if p else empty for p in parts],
            np.concatenate(counts) if counts else np.zeros(0, np.int64))


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    return np.unique(every[every > 0], return_counts=True)


def _of_part(grams: np.ndarray, part: int | None) -> np.ndarray:
    """The n-grams of a part (None: all)."""
    return grams if part is None else grams[grams >> np.uint64(64 - PART_BITS) == part]


def explode_ngrams(blocks: DataFrame, order: int, part: int | None = None) -> DataFrame:
    """(block, hash, n): every distinct n-gram of a block (of one part of the hashes, if given)
    with its occurrences there, and, but for parts other than 0, the block's words in the row
    of hash ``CORPUS``. ``block`` is the block's number << 32 plus the n-gram's among its
    n-grams of the part in the order of their unsigned hashes, from 1 (``CORPUS``: 0)."""

    def explode(key, table):
        grams, n_words = _block_grams(table.column("text"), order)
        hashes, n = _distinct([_of_part(g, part) for g in grams])
        hashes = np.concatenate(([CORPUS], hashes.view(np.int64)))
        n = np.concatenate(([n_words.sum()], n)).astype(np.int64)
        block = (key[0].as_py() << 32) + np.arange(len(n), dtype=np.int64)
        first = 1 if part else 0
        return pa.table({"block": pa.array(block[first:]), "hash": pa.array(hashes[first:], pa.int64()),
                         "n": pa.array(n[first:])})

    return blocks.groupBy("block").applyInArrow(explode, "block long, hash long, n long")


def corpus_counts(ngrams_of_blocks: DataFrame) -> DataFrame:
    """(block, hash, total): for the n-grams of every block that other blocks have too (and
    for the corpus), their occurrences in all blocks."""
    rows = ngrams_of_blocks.repartition("hash")
    # both sides use all three columns, so that Spark reads one exchange for both
    table = rows.groupBy("hash").agg(F.sum("n").alias("total"), F.count("block").alias("blocks"))
    shared = table.where((F.col("blocks") > 1) | (F.col("hash") == CORPUS)).drop("blocks")
    return rows.join(shared, "hash").where(
        (F.col("total") > F.col("n")) | (F.col("hash") == CORPUS)).select("block", "hash", "total")


def packed_counts(counts: DataFrame, part: int) -> DataFrame:
    """(block, part, places, totals): the rows of ``corpus_counts``, one packed row per block
    and batch; ``places`` are the low halves of their ``block``, ascending, ``totals`` running
    sums, as what is packed are differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column("block").to_numpy(), batch.column("total").to_numpy()))
            rows += len(batch)
            if rows >= HELD_ROWS:
                yield emit(held)
                held, rows = [], 0
        if rows:
            yield emit(held)

    def emit(held) -> pa.RecordBatch:
        at, total = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(at)
        at, total = at[order], total[order]
        block = at >> 32
        heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        places = np.split(at & 0xFFFFFFFF, heads[1:])
        return pa.RecordBatch.from_arrays(
            [pa.array(block[heads].astype(np.int32)), pa.array(np.full(len(heads), part, np.int32)),
             binary_array([pack_integers(p) for p in places]),
             binary_array([pack_integers(np.cumsum(t)) for t in np.split(total, heads[1:])])],
            ["block", "part", "places", "totals"])

    return counts.select("block", "total").mapInArrow(
        run, "block int, part int, places binary, totals binary")


def _stored_counts(dealt: DataFrame, order: int) -> DataFrame:
    """``packed_counts`` of all parts. Every part is stored before the next begins, which
    frees its shuffle files."""
    parts = [written(packed_counts(corpus_counts(explode_ngrams(dealt, order, part)), part), "counts")
             for part in range(PARTS)]
    return functools.reduce(DataFrame.unionByName, parts)


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score for every row of ``docs``."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    size_shuffles(docs.sparkSession, size * ROW_BYTES // PARTS)
    blocks = max(1, -(-size // BLOCK_CHARS))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
                        .cast("int").alias("block"))

    def score(texts, counts):
        grams, n_words = _block_grams(texts.column("text"), order)
        order_of, known, count_of, own = _places(grams, n_words)  # what no other block has is counted here
        sizes = count_of.copy()
        begins = np.searchsorted(known, np.arange(PARTS, dtype=np.uint64) << np.uint64(64 - PART_BITS))
        total = 0
        for part, places, totals in zip(*(counts.column(c) for c in ("part", "places", "totals"))):
            places, totals = (unpack_integers(v.as_py(), np.int64) for v in (places, totals))
            totals = np.diff(totals, prepend=0)
            if part.as_py() == 0 and places[0] == 0:
                total, places, totals = int(totals[0]), places[1:], totals[1:]
            count_of[begins[part.as_py()] + places - 1] = totals
        doc = np.repeat(np.arange(len(n_words)), n_words)
        outside = np.full(len(grams) * len(doc), -1, np.int64)  # -1: no n-gram ends there
        outside[order_of] = np.repeat(count_of, sizes) - own
        outside = np.split(outside, len(grams))
        scores = stupid_backoff(outside, doc, total - n_words, n_words, backoff)
        sums = np.bincount(doc, weights=scores, minlength=len(n_words))
        mean = pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                         "log_score": pa.array(sums, pa.float64()), "mean_log_score": mean})

    counts = _stored_counts(dealt, order)
    return dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        score, f"doc_id {doc_type}, n_words long, log_score double, mean_log_score double")


def _places(grams: list[np.ndarray], n_words: np.ndarray):
    """(places of the n-grams in ``grams`` end to end, in the order of their hashes; distinct
    hashes; places of each; per sorted place, the n-gram's occurrences in its document)."""
    every = np.concatenate(grams)
    live = np.flatnonzero(every > 0)
    order = live[np.argsort(every[live], kind="stable")]  # documents stay ascending
    hashes = every[order]
    doc = np.tile(np.repeat(np.arange(len(n_words), dtype=np.int32), n_words), len(grams))[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    heads = np.flatnonzero(new)
    new[1:] |= doc[1:] != doc[:-1]
    own = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order, hashes[heads], np.diff(np.append(heads, len(order))), np.repeat(own, own)


def stupid_backoff(outside: list[np.ndarray], doc: np.ndarray, total: np.ndarray, n_words: np.ndarray,
                   backoff: float) -> np.ndarray:
    """Logarithm of the score of every word. ``outside[k]``: counts of the (k+1)-gram
    that ends at the word; ``total``: words of all other documents, per document."""
    n = len(doc)
    corpus = np.maximum(total, 1)[doc].astype(np.float64)
    out = np.full(n, np.nan)
    place = np.arange(n) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    for length in range(len(outside), 0, -1):
        counts = outside[length - 1]
        # steps down from the longest context the word has
        steps = np.minimum(place + 1, len(outside)) - length
        usable = np.isnan(out) & (counts > 0)
        if length == 1:
            base = corpus
        else:
            base = np.ones(n)
            base[1:] = outside[length - 2][:-1]
        hit = np.flatnonzero(usable)
        out[hit] = np.log(counts[hit] / base[hit]) + steps[hit] * math.log(backoff)
    unseen = np.flatnonzero(np.isnan(out))
    steps = np.minimum(place + 1, len(outside))
    out[unseen] = steps[unseen] * math.log(backoff) - np.log(corpus[unseen])
    return out


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
