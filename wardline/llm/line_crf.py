"""Quality rules with line sequence labelling by a linear-chain CRF.

Base rules count words, symbols, repeated lines and repeated five-word windows
of a text. Then every line with a word gets a feature vector (length, symbols,
capitals, closing mark, repeats, position ...), Viterbi decoding of a
two-state linear-chain conditional random field marks it content or
boilerplate, and the share of word characters in content lines decides whether
the document stays.

The field is fitted here, by stochastic gradient ascent on the conditional
log-likelihood (forward-backward), on a bounded sample of labelled documents:
lines of documents with quality 1 count as content, lines of documents with
quality 0 and lines that repeat an earlier one as boilerplate. Without usable
labels the weights are zero and ties go to content.

Defined results: a null or empty text has no words, fails the base rules and
is not kept. Lines are split at ``\\n`` only and compared whole; lines without
a word neither count nor are labelled. One result row per input row, whatever
doc_id repeats or is null. An empty table gives an empty result. Only
``doc_id`` and ``text`` (``quality`` of labels) are read.
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
from wardline.llm.textblocks import TextBlock, text_blocks, window_hashes

WIDTH = 5
N_FEATURES = 12
BOILERPLATE, CONTENT = 0, 1


@dataclass(frozen=True)
class CrfParams:
    sample_docs: int = 4_000   # bound on the labelled documents used for fitting
    epochs: int = 4
    rate: float = 0.1
    l2: float = 1e-4
    min_content: float = 0.5   # least share of word characters in content lines
    min_words: int = 10
    max_repeat_percent: int = 20


def _byte_set(text: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text)] = True
    return table


_SYMBOLS = _byte_set(b"#*$%&|<>")
_CLOSING = _byte_set(b".!?:;")
_CAPITAL = _byte_set(bytes(range(65, 91)))
_DIGIT = _byte_set(b"0123456789")
_PUNCTUATION = _byte_set(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_CONTINUES = np.zeros(256, bool)  # UTF-8 continuation bytes
_CONTINUES[128:192] = True


class LineBlock:
    """Counts and line features of a block of texts."""

    def __init__(self, block: TextBlock):
        data, n_docs = block.data, len(block)
        starts, ends, first = block.words()
        words = block.hashes(starts, ends)
        chars = np.concatenate(([0], np.cumsum(~_CONTINUES[data])))
        word_chars = chars[ends] - chars[starts]
        self.n_words = np.diff(first)
        self.word_chars = _per_text(word_chars, first)
        symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
        self.n_symbols = symbols[block.offsets[1:]] - symbols[block.offsets[:-1]]
        repeated = self._repeat_words(words, first)
        self.n_repeat_words = _per_text(repeated, first)
        # lines: between line feeds, and the ends of a text
        breaks = np.flatnonzero(data == 10)
        lo = np.sort(np.concatenate((block.offsets[:-1], breaks + 1)))
        hi = np.sort(np.concatenate((breaks, block.offsets[1:])))
        w_lo, w_hi = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        live = w_hi > w_lo
        lo, hi, w_lo, w_hi = lo[live], hi[live], w_lo[live], w_hi[live]
        doc = np.searchsorted(block.offsets, lo, "right") - 1
        self.earlier = self._seen_before(doc, block.hashes(lo, hi))
        self.n_dup_lines = np.bincount(doc[self.earlier], minlength=n_docs)
        self.line_offsets = np.searchsorted(doc, np.arange(n_docs + 1))
        sums = {}
        for name, table in (("symbol", _SYMBOLS), ("capital", _CAPITAL), ("digit", _DIGIT),
                            ("mark", _PUNCTUATION)):
            total = np.concatenate(([0], np.cumsum(table[data])))
            sums[name] = total[hi] - total[lo]
        in_words = np.concatenate(([0], np.cumsum(word_chars)))
        self.line_chars = in_words[w_hi] - in_words[w_lo]
        n_in_line = w_hi - w_lo
        same = np.zeros(len(words) + 1, np.int64)
        if len(words):
            same[1:-1] = np.cumsum(words[1:] == words[:-1])
            same[-1] = same[-2]
        repeats = np.maximum(same[np.maximum(w_hi - 1, 0)] - same[w_lo], 0)
        last = data[np.maximum(ends[w_hi - 1] - 1, 0)] if len(lo) else np.zeros(0, np.uint8)
        size = np.maximum(self.line_chars, 1)
        self.features = np.column_stack((
            np.ones(len(lo)), np.minimum(np.log1p(n_in_line) / 4, 1.5), (n_in_line < 4).astype(float),
            np.minimum(sums["symbol"] / size * 5, 2), (sums["symbol"] > 0).astype(float),
            (sums["capital"] / size > 0.5).astype(float), np.minimum(sums["digit"] / size * 3, 1.5),
            np.minimum(sums["mark"] / size * 5, 2), _CLOSING[last].astype(float),
            self.earlier.astype(float), np.minimum(repeats / np.maximum(n_in_line, 1) * 3, 2),
            np.minimum(size / n_in_line / 10, 2) if len(lo) else np.zeros(0)))

    @staticmethod
    def _repeat_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """1 for every word inside a five-word window that its text has twice or more."""
        out = np.zeros(len(words), np.int64)
        windows = window_hashes(words, WIDTH)
        if not len(windows):
            return out
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(windows)]
        inside = np.flatnonzero(np.arange(len(windows)) + WIDTH <= first[text + 1])
        order = inside[np.lexsort((windows[inside], text[inside]))]
        h, t = windows[order], text[order]
        equal = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        depth = np.zeros(len(words) + 1, np.int64)
        begins = order[twice]
        depth[begins] += 1  # every window begins at its own word
        depth[begins + WIDTH] -= 1
        return (np.cumsum(depth[:-1]) > 0).astype(np.int64)

    @staticmethod
    def _seen_before(doc: np.ndarray, line_hash: np.ndarray) -> np.ndarray:
        order = np.lexsort((line_hash, doc))  # stable: earlier lines first
        h, d = line_hash[order], doc[order]
        again = np.zeros(len(order), bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        out = np.zeros(len(order), bool)
        out[order] = again
        return out


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def split_weights(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(N_FEATURES x 2 emission weights, 2 x 2 transition weights)."""
    return weights[:2 * N_FEATURES].reshape(N_FEATURES, 2), weights[2 * N_FEATURES:].reshape(2, 2)


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """Best label sequence for line scores (n x 2); ties go to content."""
    (bb, bc), (cb, cc) = transitions.tolist()
    steps = scores.tolist()
    b, c = steps[0]
    back = []
    for to_b, to_c in steps[1:]:
        from_b = BOILERPLATE if b + bb > c + cb else CONTENT
        from_c = BOILERPLATE if b + bc > c + cc else CONTENT
        back.append((from_b, from_c))
        b, c = max(b + bb, c + cb) + to_b, max(b + bc, c + cc) + to_c
    label = BOILERPLATE if b > c else CONTENT
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gradient of the conditional log-likelihood of one labelled sequence."""
    emit, trans = split_weights(weights)
    scores = x @ emit
    n = len(y)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = scores[0]
    for i in range(1, n):
        forward[i] = scores[i] + np.logaddexp(forward[i - 1, 0] + trans[0], forward[i - 1, 1] + trans[1])
    for i in range(n - 2, -1, -1):
        ahead = scores[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(trans[:, 0] + ahead[0], trans[:, 1] + ahead[1])
    total = np.logaddexp(forward[-1, 0], forward[-1, 1])
    states = np.exp(forward + backward - total)
    truth = np.zeros((n, 2))
    truth[np.arange(n), y] = 1
    g_emit = x.T @ (truth - states)
    g_trans = np.zeros((2, 2))
    if n > 1:
        np.add.at(g_trans, (y[:-1], y[1:]), 1)
        both = (forward[:-1, :, None] + trans[None] + (scores[1:] + backward[1:])[:, None, :]) - total
        g_trans -= np.exp(both).sum(axis=0)
    return np.concatenate((g_emit.reshape(-1), g_trans.reshape(-1)))


def fit(docs: DataFrame, labels: DataFrame, p: CrfParams = CrfParams()) -> np.ndarray:
    """Weights from the ``sample_docs`` labelled documents with the smallest hash of
    doc_id; the features are extracted where the texts are, one task runs the steps."""
    picked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_docs))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by sample_docs

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for block in text_blocks(batch.column("text")):
                lines = LineBlock(block)
                ids, xs, ys = [], [], []
                for i, (a, b) in enumerate(zip(lines.line_offsets[:-1], lines.line_offsets[1:])):
                    if b > a:
                        ids.append(batch.column("doc_id")[block.first + i].as_py())
                        xs.append(lines.features[a:b].astype(np.float32).tobytes())
                        good = np.full(b - a, label[block.first + i])
                        ys.append(np.where(lines.earlier[a:b], BOILERPLATE, good).astype(np.int8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())],
                    ["doc_id", "x", "y"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        w = np.zeros(2 * N_FEATURES + 4)
        squared = np.full(len(w), 1e-8)
        sequences = [(np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(np.float64),
                      np.frombuffer(y, np.int8).astype(np.int64)) for x, y in zip(rows["x"], rows["y"])]
        for epoch in range(p.epochs):
            for i in np.random.default_rng(epoch).permutation(len(sequences)):
                x, y = sequences[i]
                g = gradient(x, y, w) / len(y) - p.l2 * w
                squared += g * g
                w += p.rate * g / np.sqrt(squared)
        return pd.DataFrame({"weights": [w.tobytes()]})

    rows = sample.mapInArrow(extract, "doc_id long, x binary, y binary")
    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(model[0].weights) if model else np.zeros(2 * N_FEATURES + 4)


def label_rules(docs: DataFrame, weights: np.ndarray, p: CrfParams = CrfParams()) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept, content_share."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, trans = split_weights(weights)
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                lines = LineBlock(block)
                scores = lines.features @ emit
                share = np.zeros(len(block))
                for i, (a, b) in enumerate(zip(lines.line_offsets[:-1], lines.line_offsets[1:])):
                    if b > a:
                        content = np.array(viterbi(scores[a:b], trans))
                        chars = lines.line_chars[a:b]
                        share[i] = chars @ content / chars.sum()
                failed = ((lines.n_words < p.min_words)
                          | (100 * lines.n_repeat_words > p.max_repeat_percent * lines.n_words))
                kept = ~failed & (share >= p.min_content)
                counts = [pa.array(getattr(lines, n).astype(np.int64)) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), *counts,
                     pa.array(failed), pa.array(kept), pa.array(share)],
                    ["doc_id", *names, "base_failed", "kept", "content_share"])

    schema = f"doc_id {doc_type}, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{schema}, base_failed boolean, kept boolean, content_share double")


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return label_rules(docs, fit(docs, labels))
