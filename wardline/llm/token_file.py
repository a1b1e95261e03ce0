"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

Every text is encoded with a given tokenizers file (``add_special_tokens``
off) and closed with the end id. Ids are replaced by their frequency rank over
the whole corpus, so frequent ids take one byte. A file block holds

* ``control``: two bits per id, four ids to a byte, lowest bits first: the id
  takes 1 to 4 data bytes;
* ``data``: the ranks, little-endian, without leading zero bytes;
* ``lengths``: the ids of each document, and the documents' ids.

Blocks are rows of a Parquet dataset in ascending doc_id order (range
partitions, sorted inside) beside a ``ranks`` dataset, so writing and reading go through Spark's file system
and a lost task is simply run again. Decoding reads control bytes through a
256-row table of lengths, places all data bytes with numpy, and maps ranks
back to ids.

Texts are cut into pieces that the tokenizer keeps apart anyway (at white space
and between letters, digits and marks), and a worker encodes a distinct piece
once; the ids equal those of whole texts. That holds for tokenizers whose file
says so (checked when it is loaded); with any other, whole texts are encoded.

Defined results: null and empty texts hold the end id alone. Rows that repeat
a doc_id are separate documents, ordered by text. Null doc_ids come first. An
empty table gives no blocks and an empty result. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import shared_path, ship_package
from wardline.llm.textblocks import TextBlock, text_blocks

END_ID = 1
BLOCK_TOKENS = 1 << 18
CACHE_PIECES = 1_500_000  # pieces a worker remembers: about 100 bytes each
WORDS_AT_ONCE = 500

# Fixed values of the format: data bytes per id of a control byte (four 2-bit codes).
LENGTH_TABLE = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


class PieceTable:
    """Token ids by piece: an open-addressing table in numpy arrays, looked up for a
    whole block at once. A piece is known by its 64-bit hash and its first eight bytes."""

    def __init__(self, slots: int = 1 << 16):
        self.keys = np.zeros(slots, np.uint64)  # 0: free
        self.heads = np.zeros(slots, np.uint64)
        self.firsts = np.zeros(slots, np.int64)
        self.lengths = np.zeros(slots, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.size = 0

    def find(self, keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Slot of every piece, -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        slots = (keys & mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            found = (self.keys[at] == keys[todo]) & (self.heads[at] == heads[todo])
            out[todo[found]] = at[found]
            todo = todo[~found & (self.keys[at] != 0)]
            slots[todo] = (slots[todo] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, heads: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add distinct unknown pieces; ``ids`` holds their token ids one after another."""
        while (self.size + len(keys)) * 2 > len(self.keys):
            self._grow()
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used:self.used + len(ids)] = ids
        self._place(keys, heads, self.used + np.cumsum(lengths) - lengths, lengths)
        self.used += len(ids)
        self.size += len(keys)

    def _place(self, keys, heads, firsts, lengths) -> None:
        mask = len(self.keys) - 1
        slots = (keys & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = np.flatnonzero(self.keys[at] == 0)
            won = free[np.unique(at[free], return_index=True)[1]]  # one piece per free slot
            place, piece = at[won], todo[won]
            self.keys[place], self.heads[place] = keys[piece], heads[piece]
            self.firsts[place], self.lengths[place] = firsts[piece], lengths[piece]
            todo = np.delete(todo, won)
            slots[todo] = (slots[todo] + 1) & mask

    def _grow(self) -> None:
        live = np.flatnonzero(self.keys)
        old = self.keys[live], self.heads[live], self.firsts[live], self.lengths[live]
        slots = 2 * len(self.keys)
        self.keys, self.heads = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.firsts, self.lengths = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self._place(*old)


class PieceEncoder:
    """Token ids of texts, from a table of encoded pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = _separates_pieces(spec)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece &= bool(suffix)
        self.closes = np.zeros(self.size, bool)  # ids that end a word
        self.closes[[i for token, i in spec["model"]["vocab"].items()
                     if suffix and token.endswith(suffix)]] = True
        self.table = PieceTable()

    def _encode_pieces(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids per piece); ``plain`` marks runs of letters, which
        are one word each and so can be encoded many to a text."""
        lengths = np.zeros(len(pieces), np.int64)
        parts: list[list[int]] = [[]] * len(pieces)
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        for e, i in zip(self.tokenizer.encode_batch_fast(
                [pieces[i] for i in others.tolist()], add_special_tokens=False), others.tolist()):
            parts[i] = e.ids
            lengths[i] = len(e.ids)
        groups = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(
            [" ".join(pieces[i] for i in g.tolist()) for g in groups], add_special_tokens=False)
        runs = []
        for e, g in zip(found, groups):
            run = np.array(e.ids, np.uint32)
            closing = np.flatnonzero(self.closes[run]) + 1
            if len(closing) != len(g):  # a word that the vocabulary does not close
                lists = [x.ids for x in self.tokenizer.encode_batch_fast(
                    [pieces[i] for i in g.tolist()], add_special_tokens=False)]
                run = np.array([i for x in lists for i in x], np.uint32)
                closing = np.cumsum([len(x) for x in lists])
            lengths[g] = np.diff(closing, prepend=0)
            runs.append(run)
        ends = np.cumsum(lengths)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        inside = np.repeat(plain, lengths)
        flat[inside] = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
        for i in others.tolist():
            flat[ends[i] - lengths[i]:ends[i]] = parts[i]
        return flat, lengths

    def encode(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed with the end id; ids per text)."""
        n = len(block)
        if not self.by_piece:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(
                [block.text_bytes(i).decode("utf-8") for i in range(n)],
                add_special_tokens=False)]
            return (np.concatenate([np.array(x + [END_ID], np.uint32) for x in lists]),
                    np.array([len(x) + 1 for x in lists], np.int64))
        if self.table.size > CACHE_PIECES:
            self.table = PieceTable()
        pieces = Pieces(block)
        keys, heads = pieces.keys(), pieces.heads()
        slots = self.table.find(keys, heads)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            order = unknown[np.lexsort((heads[unknown], keys[unknown]))]
            new = np.ones(len(order), bool)
            new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (heads[order[1:]] != heads[order[:-1]])
            one = order[new]
            ids, lengths = self._encode_pieces(pieces.texts(one), pieces.plain[one])
            places = len(self.table.keys)
            self.table.add(keys[one], heads[one], ids, lengths)
            again = unknown if len(self.table.keys) == places else slice(None)  # all moved
            slots[again] = self.table.find(keys[again], heads[again])
        lengths = np.insert(self.table.lengths[slots].astype(np.int64), pieces.first[1:], 1)  # the end ids
        sources = np.insert(self.table.firsts[slots], pieces.first[1:], -1)
        total = int(lengths.sum())
        at = np.cumsum(lengths) - lengths
        is_end = sources < 0
        step = np.ones(total, np.int64)
        live = lengths > 0
        jump = sources[live].copy()
        jump[1:] -= sources[live][:-1] + lengths[live][:-1] - 1
        step[at[live]] = jump
        gather = np.cumsum(step)
        gather[at[is_end]] = 0
        ids = self.table.ids[gather]
        ids[at[is_end]] = END_ID
        closed = np.cumsum(lengths)[is_end]
        return ids, np.diff(np.concatenate(([0], closed)))


def _separates_pieces(spec: dict) -> bool:
    """The tokenizer lower-cases, drops white space, and keeps runs of letters, single
    digits and runs of other characters apart (with the usual contractions)."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    kinds = [s.get("type") for s in steps]
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"}
                    and s.get("content") == " " for s in steps)
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = [s for s in splits if s.get("type") == "Split"]
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    runs = (len(drops) == 1 and drops[0].get("behavior") == "Removed" and drops[0].get("invert")
            and drops[0]["pattern"] == {"Regex": pattern})
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                and t["content"].startswith("<|") and not set(t["content"]) & {" ", "\n"}
                for t in spec.get("added_tokens", []))
    return (collapses and runs and added and set(kinds) == {"NFC", "Replace", "Lowercase"}
            and not spec.get("post_processor"))


_GAP = np.zeros(256, bool)
_GAP[[32, 10]] = True
_OTHER, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _OTHER, np.int8)  # white space, control and non-ASCII bytes: not told apart
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """The pieces of a block: what lies between spaces and line feeds, cut where letters
    (ASCII or U+00C0 to U+00FF), digits and ASCII marks meet, lower-cased. Words with
    ``<|``, the start of an added token, stay whole and as they are; an apostrophe is
    not cut from a letter after it, as contractions are one token."""

    def __init__(self, block: TextBlock):
        raw, n = block.data, len(block.data)
        kind, data = _CLASS[raw], _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        latin = lead[~np.isin(raw[lead + 1], (0x97, 0xB7))]  # not the signs times and divided-by
        kind[latin] = kind[latin + 1] = _LETTER
        capital = latin[raw[latin + 1] < 0x9F] + 1
        data[capital] += 32
        inside = ~_GAP[raw]
        cut = np.zeros(n + 1, bool)
        cut[block.offsets] = True  # where a text begins
        cut = cut[:n]
        if n:
            before = kind[:-1]
            cut[1:] |= ((kind[1:] != before) & (kind[1:] != _OTHER) & (before != _OTHER)
                        & ~((raw[:-1] == 39) & (kind[1:] == _LETTER)))
            special = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))
            if len(special):
                starts, ends, _ = block.spans(inside)
                words = np.unique(np.searchsorted(starts, special, "right") - 1)
                for a, b in zip(starts[words].tolist(), ends[words].tolist()):
                    cut[a + 1:b] = False
                    kind[a:b] = _OTHER
                    data[a:b] = raw[a:b]
        gap_before = np.concatenate(([True], ~inside[:-1])) if n else inside
        gap_after = np.concatenate((~inside[1:], [True])) if n else inside
        cut_after = np.concatenate((cut[1:], [True])) if n else cut
        self.block = TextBlock(data, block.offsets)
        self.starts = np.flatnonzero(inside & (gap_before | cut))
        self.ends = np.flatnonzero(inside & (gap_after | cut_after)) + 1
        self.first = np.searchsorted(self.starts, block.offsets)
        letters = np.concatenate(([0], np.cumsum(kind == _LETTER)))
        self.plain = letters[self.ends] - letters[self.starts] == self.ends - self.starts

    def keys(self) -> np.ndarray:
        """A hash of each piece, never 0."""
        return self.block.hashes(self.starts, self.ends) | np.uint64(1 << 63)

    def heads(self) -> np.ndarray:
        """The first eight bytes of each piece as a number."""
        out = np.zeros(len(self.starts), np.uint64)
        length = self.ends - self.starts
        padded = np.concatenate((self.block.data, np.zeros(8, np.uint8)))
        for k in range(8):
            byte = padded[self.starts + k].astype(np.uint64)
            out |= np.where(length > k, byte, np.uint64(0)) << np.uint64(8 * k)
        return out

    def texts(self, chosen: np.ndarray) -> list[str]:
        data = self.block.data.tobytes()
        return [data[a:b].decode("utf-8") for a, b in zip(
            self.starts[chosen].tolist(), self.ends[chosen].tolist())]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One encoder, and one cache of pieces, per Python worker."""
    return PieceEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a run of ranks."""
    ranks = ranks.astype("<u4")
    extra = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF))
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    lengths = LENGTH_TABLE[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    used = np.arange(4) < lengths[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[used] = np.frombuffer(data, np.uint8)[:int(lengths.sum(dtype=np.int64))]
    return out.reshape(-1).view("<u4")


def id_ranks(docs: DataFrame, path: str) -> np.ndarray:
    """rank of every id: 0 for the most frequent over all documents, ties by id.

    Counts are summed per id; the driver receives one number per id of the
    vocabulary, whose size is fixed by the tokenizer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        counts = np.zeros(max(own.size, END_ID + 1), np.int64)
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                counts += np.bincount(own.encode(block)[0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    counted = docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).toArrow()
    size = max(encoder(path).size, END_ID + 1)
    counts = np.zeros(size, np.int64)
    counts[counted.column("id").to_numpy()] = counted.column("n").to_numpy()
    ranks = np.empty(size, np.int64)
    ranks[np.lexsort((np.arange(size), -counts))] = np.arange(size)
    return ranks


@dataclass(frozen=True)
class TokenFile:
    path: str

    @property
    def blocks(self) -> str:
        return f"{self.path}/blocks"

    @property
    def ranks(self) -> str:
        return f"{self.path}/ranks"


BLOCK_SCHEMA = ("shard int, block int, doc_ids array<long>, lengths array<long>, n_tokens long,"
                " control binary, data binary")


def write_tokens(docs: DataFrame, path: str, out: str) -> TokenFile:
    """Encode ``docs`` with the tokenizer at ``path`` and write a token file at ``out``."""
    spark = docs.sparkSession
    ranks = id_ranks(docs, path)
    target = TokenFile(out)
    spark.createDataFrame(pa.table({"id": np.arange(len(ranks)), "rank": ranks})).write.parquet(
        target.ranks)
    packed = ranks.astype(np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = encoder(path), np.frombuffer(packed, np.uint32)
        doc_ids, lengths, ids, shard, block = [], [], [], 0, 0

        def emit() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            control, data = pack(table[flat])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([len(flat)]), pa.array([control], pa.binary()),
                 pa.array([data], pa.binary())],
                ["shard", "block", "doc_ids", "lengths", "n_tokens", "control", "data"])

        held = 0
        for batch in batches:
            if len(batch):
                shard = batch.column("shard")[0].as_py()
            names = batch.column("doc_id").to_pylist()
            for piece in text_blocks(batch.column("text"), 1 << 20):
                flat, counts = own.encode(piece)
                doc_ids += names[piece.first:piece.first + len(piece)]
                lengths += counts.tolist()
                ids.append(flat)
                held += len(flat)
                if held >= BLOCK_TOKENS:
                    yield emit()
                    doc_ids, lengths, ids, held, block = [], [], [], 0, block + 1
        if doc_ids:
            yield emit()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(parts, "doc_id").withColumn("shard", F.spark_partition_id())
               .sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(target.blocks)
    return target


def read_tokens(spark: SparkSession, file: TokenFile) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32 and, last, its
    place (shard, block, item). ``start`` counts the ids of all documents before it."""
    ranks = spark.read.parquet(file.ranks).toArrow()  # one row per id of the vocabulary
    ids = np.zeros(ranks.num_rows, np.uint32)
    ids[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()
    packed = ids.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(packed, "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                flat = table[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                ends = np.cumsum(row["lengths"])
                crcs = [zlib.crc32(flat[e - n:e].tobytes()) for e, n in zip(ends, row["lengths"])]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()),
                     pa.array(ends - np.array(row["lengths"])), pa.array(row["lengths"], pa.int64()),
                     pa.array(crcs, pa.int64()), pa.array([row["shard"]] * n, pa.int32()),
                     pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32())],
                    ["doc_id", "inside", "n_tokens", "ids_crc32", "shard", "block", "item"])

    blocks = spark.read.parquet(file.blocks)
    docs = blocks.mapInArrow(run, "doc_id long, inside long, n_tokens long, ids_crc32 long,"
                                  " shard int, block int, item int")
    # Offsets of blocks: running totals per shard, plus the totals of the shards before;
    # a shard is one range partition, so the second window has one row per partition.
    sizes = blocks.select("shard", "block", "n_tokens")
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = totals.select("shard", F.coalesce(F.sum("total").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("block")
    placed = sizes.join(earlier, "shard").select(
        "shard", "block", (F.col("base") + F.sum("n_tokens").over(inner) - F.col("n_tokens"))
        .alias("base"))
    return docs.join(placed, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32",
        "shard", "block", "item")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and read it back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, path, shared_path(spark, "tokens")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, default_tokenizer())
