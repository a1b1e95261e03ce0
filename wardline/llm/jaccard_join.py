"""N-gram Jaccard join with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of distinct
five-word shingles is at least 3/4. The join is exact:

1. Every document's set is hashed (64 bits per shingle); documents with equal
   sets share one set id from here on. The same scan counts shingles in 2**21
   hash cells, a table of fixed size, and cells that stand out of the ordinary
   load mark their shingles as frequent.
2. Shingles are ordered rare before frequent, then by hash. A set of n
   shingles can miss at most floor(n/4) of them in a partner, so it indexes a
   prefix that two partners cannot both exhaust: rare shingles count one each
   and are indexed alone; frequent ones are split into hash groups, count one
   less than their number per group, and every two of a group are indexed as
   one combined signature. Where rare shingles do not reach the required
   count, the prefix extends into the frequent ones. Group counts depend on a
   size level (partners are at most one level apart, and a set is indexed at
   its own level and the one below).
3. Sets that share a signature are linked by representatives first and
   exhaustively where still apart (``link_by_signatures``); pairs are dropped
   early only by their sizes or an upper bound on their overlap, and links are
   verified on whole sets.

Shingle and set hashes are 64-bit; equal hashes count as equal items.

Defined results: null texts, and texts without words, have an empty set and
link with nothing. One result row per input row; rows that repeat a doc_id
keep their own sets and are not linked by the id itself. A null doc_id takes
part through its text and never names a component, unless no row of the
component has an id (then component_id is null). Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.components import connected_components, link_by_signatures, shared_signatures
from wardline.llm.deploy import free_name, ship_package, written
from wardline.llm.textblocks import binary_array, mix, shingles, text_blocks, word_hashes

WIDTH = 5
SIMILAR, OF = 75, 100           # link when OF * |intersection| >= SIMILAR * |union|
CELL_BITS, CELL_BLOCK = 21, 4096
FILTER_BITS = 23                # size of the id filter sent to the verifying scan


def _levels() -> np.ndarray:
    """Lower bounds of the size levels; a partner's size is at most one level away."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 4 // 3 + 1)
    return np.array(bounds, np.int64)


LEVELS = _levels()


def set_id(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set of shingles."""
    total = np.add.reduce(mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F)), dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(tokens))], np.uint64))[0].astype(np.int64))


def _document_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text of the column."""
    for block in text_blocks(column):
        hashes, word_offsets = word_hashes(block.lower())
        for i, tokens in enumerate(shingles(hashes, word_offsets, WIDTH)):
            yield block.first + i, tokens


def measure(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, cells): one row per document, and per task the cells that it met, as
    (place in the block, count) pairs."""
    doc_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        names = ["doc_id", "n", "id", "block", "counts"]
        for batch in batches:
            sizes, ids = np.zeros(len(batch), np.int64), [None] * len(batch)
            pending: list[np.ndarray] = []
            for row, tokens in _document_sets(batch.column("text")):
                sizes[row] = len(tokens)
                if len(tokens):
                    ids[row] = set_id(tokens)
                    pending.append(tokens)
                if len(pending) >= 512:
                    counts += _cell_counts(pending)
                    pending = []
            if pending:
                counts += _cell_counts(pending)
            empty = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(ids, pa.int64()),
                 empty.cast(pa.int32()), empty.cast(pa.binary())], names)
        cells = np.flatnonzero(counts)  # as many as the task has shingles, at most
        if len(cells):
            pairs = np.column_stack((cells % CELL_BLOCK, counts[cells])).astype(np.uint32)
            blocks, first = np.unique(cells // CELL_BLOCK, return_index=True)
            empty = pa.nulls(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [empty.cast(_arrow(doc_type)), empty.cast(pa.int64()), empty.cast(pa.int64()),
                 pa.array(blocks.astype(np.int32)), binary_array(np.split(pairs, first[1:]))], names)

    schema = f"doc_id {doc_type.simpleString()}, n long, id long, block int, counts binary"
    both = written(docs.select("doc_id", "text").mapInArrow(run, schema), "sets")
    return (both.where("block is null").select("doc_id", "n", "id"),
            both.where("block is not null").select("block", "counts"))


def _arrow(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(data_type)


def _cell_counts(sets: list[np.ndarray]) -> np.ndarray:
    cells = (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return np.bincount(cells, minlength=1 << CELL_BITS).astype(np.uint32)


def frequent_cells(cells: DataFrame) -> np.ndarray:
    """Boolean per cell: its count stands 4 deviations and 8 above the ordinary load.

    Partial counts are summed per block of cells in two levels, so no task
    adds more than a share of the partial rows; the driver receives one bit
    per cell (256 KB).
    """

    def add(rows):
        pairs = np.frombuffer(b"".join(rows["counts"]), np.uint32).reshape(-1, 2)
        total = np.bincount(pairs[:, 0], pairs[:, 1], CELL_BLOCK).astype(np.int64)
        return rows[["block"]].head(1).assign(counts=[total.tobytes()])

    def mark(rows):
        total = np.sum([np.frombuffer(part, np.int64) for part in rows["counts"]], axis=0)
        load = float(np.median(total))
        high = total > load + 4.0 * np.sqrt(load) + 8.0
        return rows[["block"]].head(1).assign(counts=[np.packbits(high).tobytes()])

    schema = "block int, counts binary"
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(64)))
    sums = salted.groupBy("block", "salt").applyInPandas(add, schema)
    flags = np.zeros(1 << CELL_BITS, bool)
    for row in sums.groupBy("block").applyInPandas(mark, schema).collect():  # one row a block
        at = row.block * CELL_BLOCK
        flags[at:at + CELL_BLOCK] = np.unpackbits(np.frombuffer(row.counts, np.uint8)).astype(bool)
    return flags


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """(signatures, deficit) of one set. Single signatures are even, combined ones
    odd; deficit is what the rare shingles fall short of the required count."""
    n = len(tokens)
    need = n // 4 + 1
    high = frequent[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    rare, common = tokens[~high], tokens[high]
    singles = rare[:need] & ~np.uint64(1)
    deficit = need - len(singles)
    if not deficit or n < 2:
        return singles, deficit
    out = [singles]
    level = int(np.searchsorted(LEVELS, n, "right")) - 1
    for at in (level, level - 1):
        if at < 0:
            continue
        groups = max(1, int(LEVELS[at]) // 16)
        group = (common % np.uint64(groups)).astype(np.int64)
        new = np.zeros(len(common), bool)
        new[np.unique(group, return_index=True)[1]] = True
        reached = np.searchsorted(np.cumsum(~new), deficit) + 1
        order = np.argsort(group[:reached], kind="stable")
        chosen, of = common[:reached][order], group[:reached][order]
        for distance in range(1, len(chosen)):  # pairs of a group, by their distance in it
            same = of[distance:] == of[:-distance]
            if not same.any():
                break
            a, b = chosen[:-distance][same], chosen[distance:][same]
            out.append(mix(a * np.uint64(0x9FB21C651E98DF25) + mix(b + np.uint64(at)))
                       | np.uint64(1))
    return np.concatenate(out), deficit


def index(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, id, deficit) postings of all sets; a task emits a repeated set once
    while it remembers it (a bounded memory; later repeats are merged by the shuffle)."""
    packed = np.packbits(frequent).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        seen: set[int] = set()
        sigs, ids, deficits, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            counts = [len(s) for s in sigs]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sigs).view(np.int64)),
                 pa.array(np.repeat(np.array(ids, np.int64), counts)),
                 pa.array(np.repeat(np.array(deficits, np.int32), counts))],
                ["sig", "id", "deficit"])

        for batch in batches:
            for _, tokens in _document_sets(batch.column("text")):
                if not len(tokens):
                    continue
                key = set_id(tokens)
                if key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                found, deficit = signatures(tokens, flags)
                if len(found):
                    sigs.append(found)
                    ids.append(key)
                    deficits.append(deficit)
                    size += len(found)
                if size >= 200_000:
                    yield emit()
                    sigs, ids, deficits, size = [], [], [], 0
        if size:
            yield emit()

    return docs.select("text").mapInArrow(run, "sig long, id long, deficit int")


def id_filter(ids: DataFrame, width: int = FILTER_BITS) -> bytes:
    """A bitmap of 2**width bits (1 MB) with the top bits of every id."""
    cell = F.shiftrightunsigned(F.col("id"), 64 - width) + F.lit(1)
    rows = ids.select(cell.alias("cell")).groupBy(
        F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    out = bytearray(1 << (width - 3))
    for row in rows:
        at = (row.bucket - 1) * 4096
        out[at:at + 4096] = row.bits
    return bytes(out)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, content) of the wanted sets, recomputed from the texts in one scan; the
    fixed-size filter keeps other sets out of the shuffle."""
    bits = id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        seen: set[int] = set()
        keys, parts, size = [], [], 0

        def emit() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            values = pa.array(np.concatenate(parts).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["id", "content"])

        for batch in batches:
            for _, tokens in _document_sets(batch.column("text")):
                if not len(tokens):
                    continue
                key = set_id(tokens)
                if not wanted[(key & (1 << 64) - 1) >> 64 - FILTER_BITS] or key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                parts.append(tokens)
                size += len(tokens)
                if size >= 100_000:
                    yield emit()
                    keys, parts, size = [], [], 0
        if keys:
            yield emit()

    found = docs.select("text").mapInArrow(run, "id long, content array<long>")
    return found.join(ids, "id", "left_semi")


def link(docs: DataFrame, sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Links (a, b) between set ids; see ``link_by_signatures``."""
    sizes = sets.where("n > 0").groupBy("id").agg(F.max("n").alias("n"))
    postings = shared_signatures(index(docs, frequent)).join(sizes, "id")

    # |A & B| >= t |A | B| is OF+SIMILAR times the overlap >= SIMILAR times both sizes
    required = F.expr(f"({SIMILAR} * (n_a + n_b) + {OF + SIMILAR - 1}) div {OF + SIMILAR}")

    def fits() -> Column:
        return F.least("n_a", "n_b") >= required

    def promising(pairs: DataFrame) -> DataFrame:
        need = F.expr("least(n_a, n_b) div 4 + 1")
        return pairs.where(fits() & (F.col("combined") | (F.col("shared") * 4 >= need)))

    def possible(pairs: DataFrame) -> DataFrame:
        # all shared rare shingles of the shorter prefix are counted in `shared`
        rest = F.expr("greatest(n_a - (n_a div 4 + 1) + deficit_a,"
                      " n_b - (n_b div 4 + 1) + deficit_b)")
        return pairs.where(F.col("shared") + rest >= required)

    def similar(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("content_a", "content_b"))
        union = F.size("content_a") + F.size("content_b") - common
        return pairs.where(common * OF >= union * SIMILAR)

    def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.values.to_numpy(), column.offsets.to_numpy()

    return link_by_signatures(postings, promising, possible, fits, lambda ids: sets_of(docs, ids),
                              similar, decode, (SIMILAR, OF))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    sets, cells = measure(docs)
    links = written(link(docs, sets, frequent_cells(cells)), "links")
    firsts = sets.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("first_id"))
    labels = connected_components(links)
    named = firsts.join(labels, "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "label").select("id", "component_id")
    return sets.join(named, "id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (all columns) per component: that of the smallest doc_id (null
    comes last), then text hash; and every row whose text is empty. Rows that repeat a
    doc_id and text count as one, rows of one doc_id with other texts stand for themselves."""
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64("text").alias("text_key"))
    rows = jaccard_components(docs.select(place.alias("doc_id"), "text")).where("n_shingles > 0")
    keys = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("component_id").alias("component_id"))
    owner, key, first = (free_name(docs, c) for c in ("owner", "text_key", "first"))
    gone = written(keys.withColumn("opens", F.col("component_id") == F.col("doc_id")).where(
        "n > 1 or not opens").select(F.col("doc_id.doc_id").alias(owner), F.col("doc_id.text_key").alias(key),
                                     "opens"), "gone")
    hit = F.col("doc_id").eqNullSafe(F.col(owner)) & (F.xxhash64("text") == F.col(key))
    single = docs.join(gone.drop("opens"), hit, "left_anti")
    repeated = gone.where("opens").drop("opens")
    if repeated.isEmpty():
        return single.select(*docs.columns)
    order = [c.name for c in docs.schema if c.dataType.typeName() not in ("map", "variant")]
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*order))
    one = docs.join(repeated, hit, "left_semi").withColumn(first, F.row_number().over(copies)).where(
        F.col(first) == 1)
    return single.select(*docs.columns).unionByName(one.select(*docs.columns))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


JACCARD_SQL = r"""
with recursive said as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from said, unnest(range(1, greatest(len(w) - 3, 2))) as t(i) where len(w) > 0),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (
  select x, y from pair join size p on p.doc_id = x join size q on q.doc_id = y
  where 100 * c >= 75 * (p.n + q.n - c)),
both_ways as (select x, y from link union all select y, x from link),
reach as (
  select doc_id, doc_id as other from said
  union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(other) as component_id
from reach left join size using (doc_id) group by doc_id, n"""
