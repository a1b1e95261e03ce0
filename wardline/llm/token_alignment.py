"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by tokenizer A (byte-level BPE, with a space put before the text)
and by tokenizer B (sentencepiece, which puts that space itself). Byte offsets where
a token of A and a token of B both end cut the tokens into groups; every A token of
a group is linked with every B token of it. A pair of ids counts once for each
document that holds it linked.

The work runs in Arrow, a few megabytes of text at a time:

* tokens are list columns; flattened values and parent indices give one row per token;
* cumulative sums of token lengths, less the sum at the document's start, give the
  documents' end offsets;
* a hash join of the two token tables on (document, end) finds the cuts, and
  cumulative counts of cuts number the groups;
* every A token is paired with the B tokens of its group (in large groups each id
  once, with its count), and ``Table.group_by`` sums the pairs of a document.

Spark adds up what blocks of documents find. The first pass stores one row per
document with its distinct pairs. ``Table.group_by`` counts the pairs of a block,
Spark sums the blocks' counts by pair and marks the highest of each A id, and the
counts go back to the blocks that asked for them, once per block, where they are
joined to the documents' pairs. So the pair of two frequent tokens is one row per
block, not one per document.

Texts are cut before a space that follows another character and precedes an ASCII
one: both tokenizers keep such pieces apart (checked when they are loaded; otherwise
whole texts are encoded), so a worker encodes a distinct piece once.

Defined results: texts that are null or empty, or whose joined token bytes differ
from space + text in A or B (such as texts with U+2581, which B reads as a space),
have no tokens: zeros and an empty digest. Strings of special tokens are plain text.
Rows are documents, also where doc_id is repeated or null. An empty table gives no
rows. A very long text is a block of its own, held whole by one task. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_file, ship_package, written
from wardline.llm.textblocks import TextBlock, text_blocks
from wardline.operators.joins import stored_bytes
from wardline.session import size_shuffles

BLOCK_PAIRS = 1 << 20     # distinct (document, pair) rows of a block
SLICE_BYTES = 1 << 20     # text aligned at a time
CACHE_PIECES, CACHE_IDS = 300_000, 2_000_000  # pieces a worker remembers, and their A ids
PIECES_AT_ONCE = 10_000
LARGE_GROUP = 1000        # links beyond which a group's tokens are counted by id first
WORD_MARK = "\u2581"  # sentencepiece's space


@dataclass(frozen=True)
class Tokenizers:
    """Names of files sent to the workers: a tokenizers JSON and a sentencepiece model."""

    a: str
    b: str


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level BPE writes bytes: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    for n, b in enumerate(sorted(set(range(256)) - set(own))):
        out[chr(256 + n)] = b
    return out


class _Side:
    """Token ids of pieces, and the bytes of every id."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = pa.array(token_bytes, pa.binary())
        self.lengths = pa.array([len(t) for t in token_bytes], pa.int64())
        ids = [str(i) for i in range(len(token_bytes))]
        # every id with what can follow it in a digest
        self.printed = pa.array([i + end for end in ",|;" for i in ids], pa.string())
        self.size = len(ids)


class SideA(_Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        # this splitter keeps a space with the letters, digits or marks after it
        self.splits = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                       and not before.get("add_prefix_space") and not spec.get("normalizer"))
        alphabet = _byte_alphabet()
        plain = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            plain[i] = (bytes(alphabet[c] for c in token) if all(c in alphabet for c in token)
                        else token.encode())
        super().__init__(plain)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class SideB(_Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        usual = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
                 for i in range(len(pieces))]
        # no piece reaches from another character over a space
        self.splits = not any(WORD_MARK in p.lstrip(WORD_MARK) for p, u in zip(pieces, usual) if u)
        # as the space before a text, the space before a piece is put by the model
        self.splits &= model.encode("a", out_type=str)[0].startswith(WORD_MARK)
        super().__init__([
            bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(WORD_MARK, " ").encode()
            if usual[i] else b"" for i, p in enumerate(pieces)])

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in pieces], num_threads=1)


class _Lists:
    """Growing lists of ids, stored one after another."""

    def __init__(self):
        self.values, self.ends = array("i"), array("i", [0])

    def add(self, lists: list[list[int]]) -> None:
        ends = np.cumsum(np.fromiter(map(len, lists), np.int32, len(lists)), dtype=np.int32)
        self.ends.frombytes((ends + np.int32(len(self.values))).tobytes())
        self.values.extend(chain.from_iterable(lists))

    def array(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.array(self.ends)), pa.array(np.array(self.values)))


class Encoder:
    """Both tokenizers, with the ids of the pieces seen so far."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.splits = self.a.splits and self.b.splits
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lists = _Lists(), _Lists()
        self.arrays = self.lists[0].array(), self.lists[1].array()

    def _cuts(self, block: TextBlock) -> np.ndarray:
        """Where pieces begin; every text begins with a space, so none ends in a cut."""
        data = block.data
        if not self.splits or len(data) < 3:
            return block.offsets[:-1]
        begins = np.zeros(len(data), bool)
        begins[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & (data[2:] > 32) & (data[2:] < 127)
        begins[block.offsets[:-1]] = True
        return np.flatnonzero(begins)

    def encode(self, block: TextBlock) -> tuple[pa.ListArray, pa.ListArray]:
        """One list of ids per text, for A and for B."""
        if len(self.known) > CACHE_PIECES or len(self.lists[0].values) > CACHE_IDS:
            self._clear()
        cuts = self._cuts(block)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts), [
            None, pa.py_buffer(np.append(cuts, len(block.data)).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(block.data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            for first in range(0, len(new), PIECES_AT_ONCE):
                some = new[first:first + PIECES_AT_ONCE]
                self.lists[0].add(self.a.encode(some))
                self.lists[1].add(self.b.encode(some))
            self.arrays = self.lists[0].array(), self.lists[1].array()
        at = pa.array(np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct)))
        at = at.take(pieces.indices)
        first = np.searchsorted(cuts, block.offsets)
        out = []
        for lists in self.arrays:
            of_piece = lists.take(at)
            n = np.concatenate(([0], np.cumsum(pc.list_value_length(of_piece).to_numpy())))
            out.append(pa.ListArray.from_arrays(pa.array(n[first].astype(np.int32)),
                                                pc.list_flatten(of_piece)))
        return out[0], out[1]


@lru_cache(maxsize=1)
def encoder(path_a: str, path_b: str) -> Encoder:
    return Encoder(path_a, path_b)


def _spelled(tokens: pa.ListArray, side: _Side) -> np.ndarray:
    """All token bytes, one after another."""
    joined = side.bytes.take(pc.list_flatten(tokens))
    offsets = np.frombuffer(joined.buffers()[1], np.int32)
    offsets = offsets[joined.offset:joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    if data is None or not len(joined):
        return np.zeros(0, np.uint8)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def _totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _faithful(block: TextBlock, sides: tuple[_Side, _Side],
              tokens: tuple[pa.ListArray, pa.ListArray]) -> np.ndarray:
    """Texts that hold more than the space and whose tokens spell them in A and B."""
    size = np.diff(block.offsets)
    good = size > 1
    for side, lists in zip(sides, tokens):
        lengths = side.lengths.take(pc.list_flatten(lists)).to_numpy()
        good &= _totals(lengths, lists.offsets.to_numpy()) == size
    alike = np.flatnonzero(good)  # sizes are equal, bytes may differ
    data, mask = block.data[np.repeat(good, size)], pa.array(good)
    offsets = np.concatenate(([0], np.cumsum(size[alike])))
    for side, lists in zip(sides, tokens):
        differ = _spelled(lists.filter(mask), side) != data
        good[alike[_totals(differ, offsets) > 0]] = False
    return good


def _tokens(lists: pa.ListArray, side: _Side, name: str) -> pa.Table:
    """One row per token: its document and end offset there as one key, its place
    among all tokens. Every document has tokens."""
    ids = pc.list_flatten(lists)
    doc = pc.list_parent_indices(lists)
    lengths = side.lengths.take(ids)
    ends = pc.cumulative_sum(lengths)
    start = pc.subtract(ends, lengths).take(lists.offsets[:-1])
    return pa.table({"key": pc.add(pc.shift_left(doc, 40), pc.subtract(ends, start.take(doc))),
                     name: pa.array(np.arange(len(ids)))})


def _distinct(ids: np.ndarray, group: np.ndarray, n_groups: int,
              large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, groups, counts, first of each group): the tokens by group; in large groups
    an id comes once, with its count."""
    many = large[group]
    counts = np.ones(len(ids), np.int64)
    if many.any():
        found = pa.table({"group": group[many], "id": ids[many]}).group_by(
            ["group", "id"], use_threads=False).aggregate([([], "count_all")])
        ids = np.concatenate((ids[~many], found.column("id").to_numpy()))
        group = np.concatenate((group[~many], found.column("group").to_numpy()))
        counts = np.concatenate((counts[~many], found.column("count_all").to_numpy()))
        order = np.argsort(group, kind="stable")
        ids, group, counts = ids[order], group[order], counts[order]
    return ids, group, counts, np.searchsorted(group, np.arange(n_groups + 1))


def _links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray,
           doc_of: np.ndarray) -> pa.Table:
    """(doc, pair, times): every pair of ids of a group, summed per document."""
    n = len(doc_of)
    large = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n) > LARGE_GROUP
    a, group, count_a, _ = _distinct(a, group_a, n, large)
    b, _, count_b, first_b = _distinct(b, group_b, n, large)
    fan = np.diff(first_b)[group]  # every A token meets the B tokens of its group
    left = np.repeat(np.arange(len(a)), fan)
    right = np.arange(len(left)) + np.repeat(first_b[group] - np.cumsum(fan) + fan, fan)
    links = pa.table({"doc": doc_of[group[left]], "times": count_a[left] * count_b[right],
                      "pair": (a[left].astype(np.int64) << 32) + b[right]})
    return links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])


def _groups(n: int, cuts: np.ndarray) -> np.ndarray:
    """Group number of each of n tokens; ``cuts`` are the last tokens of the groups."""
    last = np.zeros(n, np.int64)
    last[cuts] = 1
    return pc.cumulative_sum(pa.array(last)).to_numpy() - last


def _digests(ids: list[np.ndarray], groups: list[np.ndarray], n_groups: int,
             doc_groups: np.ndarray, sides: tuple[_Side, _Side]) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` per document; ``doc_groups``: groups before each."""
    ends_a, ends_b = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in groups)
    place_a = np.arange(len(ids[0])) + np.concatenate(([0], ends_b))[groups[0]]
    place_b = np.arange(len(ids[1])) + ends_a[groups[1]]
    mark_a, mark_b = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)
    mark_a[ends_a - 1], mark_b[ends_b - 1] = 1, 2
    pieces = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    pieces[place_a] = ids[0] + mark_a * sides[0].size
    pieces[place_b] = ids[1] + mark_b * sides[1].size + len(sides[0].printed)
    printed = pa.concat_arrays([sides[0].printed, sides[1].printed]).take(pa.array(pieces))
    offsets = np.frombuffer(printed.buffers()[1], np.int32)[printed.offset:]
    text = memoryview(printed.buffers()[2]) if len(printed) else memoryview(b"")
    starts = np.concatenate(([0], ends_a + ends_b))[doc_groups]
    return [hashlib.sha256(text[offsets[lo]:offsets[hi] - 1]).hexdigest()
            for lo, hi in zip(starts[:-1], starts[1:])]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def align(block: TextBlock, enc: Encoder) -> dict[str, list | np.ndarray | pa.Array]:
    """Per text of ``block`` (each with the space before it): the numbers, the digest, and
    its distinct pairs (A id * 2**32 + B id) with the number of links each has."""
    n = len(block)
    numbers = {name: np.zeros(n, np.int64) for name in NUMBERS}
    digests = np.full(n, "", object)
    sides, tokens = (enc.a, enc.b), enc.encode(block)
    good = _faithful(block, sides, tokens)
    kept = np.flatnonzero(good)
    pairs = {"doc": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    if len(kept):
        lists = [t.filter(pa.array(good)) for t in tokens]
        a, b = _tokens(lists[0], enc.a, "a"), _tokens(lists[1], enc.b, "b")
        cuts = a.join(b, "key", join_type="inner", use_threads=False).sort_by("key")
        doc_of = cuts.column("key").to_numpy() >> 40
        ids = [pc.list_flatten(t).to_numpy() for t in lists]
        groups = [_groups(len(i), cuts.column(c).to_numpy()) for i, c in zip(ids, "ab")]
        linked = _links(ids[0], groups[0], ids[1], groups[1], doc_of).sort_by(
            [("doc", "ascending"), ("pair", "ascending")])
        pairs = {"doc": kept[linked.column("doc").to_numpy()],
                 "pair": linked.column("pair").to_numpy(), "times": linked.column("times_sum").to_numpy()}
        for name, t in zip(NUMBERS, lists):
            numbers[name][kept] = pc.list_value_length(t).to_numpy()
        numbers["n_groups"][kept] = np.bincount(doc_of, minlength=len(kept))
        numbers["n_links"] = np.bincount(pairs["doc"], pairs["times"], n).astype(np.int64)
        doc_groups = np.concatenate(([0], np.cumsum(numbers["n_groups"][kept])))
        digests[kept] = _digests(ids, groups, len(cuts), doc_groups, sides)
    offsets = pa.array(np.searchsorted(pairs["doc"], np.arange(n + 1)).astype(np.int32))
    return {**numbers, "groups_sha256": digests.tolist(),
            "pair": pa.ListArray.from_arrays(offsets, pa.array(pairs["pair"], pa.int64())),
            "times": pa.ListArray.from_arrays(offsets, pa.array(pairs["times"], pa.int64()))}


def aligned(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """One stored row per document: its block, doc_id, numbers, digest and pairs."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(files.a), SparkFiles.get(files.b))
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            spaced = pc.binary_join_element_wise(
                pa.scalar(" "), pc.fill_null(batch.column("text"), ""), pa.scalar(""))
            for part in text_blocks(spaced, SLICE_BYTES):
                found = align(part, enc)
                if held and held + len(found["pair"].values) > BLOCK_PAIRS:
                    block, held = block + 1, 0
                held += len(found["pair"].values)
                yield pa.RecordBatch.from_pydict({
                    "block": np.full(len(part), block),
                    "doc_id": batch.column("doc_id").slice(part.first, len(part)), **found})

    schema = (f"block long, doc_id {doc_type}, " + ", ".join(f"{c} long" for c in NUMBERS)
              + ", groups_sha256 string, pair array<long>, times array<long>")
    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "alignment")


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n): how many documents of a block hold each pair."""

    def counted(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["block", "pair"], use_threads=False).aggregate(
            [("n", "sum")]).rename_columns({"n_sum": "n"})

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        pairs = batch.column("pair")
        block = batch.column("block").take(pc.list_parent_indices(pairs))
        flat = pc.list_flatten(pairs)
        held.append(pa.table({"block": block, "pair": flat,
                              "n": pa.array(np.ones(len(flat), np.int64))}))
        size += len(flat)
        if size > 2 * BLOCK_PAIRS:
            held = [counted(held)]
            if len(held[0]) > BLOCK_PAIRS:  # partial counts; Spark adds them up
                yield from held[0].combine_chunks().to_batches()
                held = []
            size = sum(map(len, held))
    if held:
        yield from counted(held).combine_chunks().to_batches()


def pair_counts(partial: DataFrame) -> DataFrame:
    """(pair, n, best): documents per pair; ``best`` marks the highest of its A id."""
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most B's vocabulary per A id
    return partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn(
        "best", F.col("n") == F.max("n").over(of_a))


def alignment(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    stored = aligned(docs, files)
    partial = written(stored.select("block", "pair").mapInArrow(
        _pairs_of_blocks, "block long, pair long, n long"), "alignment-partial")
    answers = partial.select("block", "pair").join(pair_counts(partial), "pair")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def weigh(documents: pa.Table, counts: pa.Table) -> pa.Table:
        """A block's documents with the counts of their pairs."""
        lists = documents.column("pair").combine_chunks()
        doc = pc.list_parent_indices(lists)
        links = pa.table({"doc": doc, "pair": pc.list_flatten(lists),
                          "times": pc.list_flatten(documents.column("times").combine_chunks())})
        counts = counts.select(["pair", "n", "best"]).group_by("pair", use_threads=False).aggregate(
            [("n", "max"), ("best", "max")])  # a block may have asked twice
        links = links.join(counts, "pair", join_type="inner", use_threads=False)
        links = pa.table({"doc": links.column("doc"),
                          "sum": pc.multiply(links.column("times"), links.column("n_max")),
                          "best": pc.if_else(links.column("best_max"), links.column("times"), 0)})
        sums = links.group_by("doc", use_threads=False).aggregate([("sum", "sum"), ("best", "sum")])
        at = sums.column("doc").to_numpy()
        out = documents.drop_columns(["block", "pair", "times"])
        for name in ("best", "sum"):
            column = np.zeros(len(out), np.int64)
            column[at] = sums.column(f"{name}_sum").to_numpy()
            out = out.append_column({"best": "n_best", "sum": "count_sum"}[name], pa.array(column))
        return out

    schema = (f"doc_id {doc_type}, " + ", ".join(f"{c} long" for c in NUMBERS)
              + ", groups_sha256 string, n_best long, count_sum long")
    return (stored.toDF(*stored.columns).groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(weigh, schema)
            .select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"))


def default_tokenizers(spark: SparkSession) -> Tokenizers:
    import public_tokenizers

    return Tokenizers(*(ship_file(spark, public_tokenizers.path(name))
                        for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size_shuffles(spark, stored_bytes(docs))
    return alignment(docs, default_tokenizers(spark))
