"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a ``WINDOW``-byte string that covers it also starts in a
document with a smaller doc_id. The job never sorts the suffixes that cannot
matter:

1. Anchors: every window owns the 20-byte gram of least hash inside it, so
   equal windows own equal anchors. A first scan sends each task's distinct
   anchor hashes, packed by hash range; anchors of two documents are marked in
   a bitmap of fixed size (16 MB; should it fill up, more windows are
   examined, none is lost).
2. The *content* of an anchor's run of neighbouring windows is at most 80 bytes.
   A second scan sends the hashes of each task's distinct contents at marked
   anchors with their smallest and largest document. Where an anchor has one
   content only, as inside long copies, that settles its windows.
3. For the others the contents themselves are sent. Per anchor, the suffixes that start at the windows of its contents are
   sorted: a bottom-up mergesort whose comparisons find the longest common
   extension by binary search over prefix polynomial hashes (logarithmic in
   its length), and neighbours that agree over a whole window are compared
   byte by byte, so a hash collision cannot join them. Each class of equal
   windows gets its smallest document. Only distinct contents are sorted: a
   passage in a third of all documents is a few of them.
4. The contents with a verdict are marked in a second bitmap of fixed size. Their occurrences,
   and few others, meet the verdicts in a hash join, and the removed spans meet the texts by
   document.

Defined results: null or empty texts have no bytes, keep the empty string.
Rows that repeat a doc_id are told apart by their text; they do not count as
smaller than each other. A null doc_id is neither smaller nor larger than any
other: the row keeps all its bytes and removes none. An empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.deploy import ship_package, written
from wardline.llm.textblocks import (TextBlock, binary_array, mix, pack_integers, text_blocks,
                                      unpack_integers)

WINDOW = 50
GRAM = 20
SPAN = WINDOW - GRAM + 1        # grams in a window
MAP_BITS = 27
RANGE_BITS = 6                  # least number of top bits of the hash by which anchors are merged
RANGE_CHARS = 1 << 23           # texts whose anchors one range merges at a time, about
BLOCK_BYTES = 1 << 18           # a scan's working arrays take up to a hundred times as much
HELD_ROWS = 1 << 19             # rows a scan holds until it sends the distinct ones
SORT_ROWS = 400_000             # suffixes sorted at a time


def owned_runs(block: TextBlock):
    """(starts, ends, anchors, gram_hash): windows starting in starts[i]..ends[i]-1 own
    the gram at anchors[i]. Every window of the block lies in exactly one run."""
    data, n = block.data, len(block.data)
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty, np.zeros(0, np.uint64), None
    prefix = block.prefix_hash()
    at = np.arange(n - GRAM + 1)
    gram = mix(block.span_hash(prefix, at, at + GRAM))
    # least 32 bits of hash first, the rightmost of equal ones; unique per position
    key = (gram >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    least, width = key, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    owner = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    valid = np.ones(len(owner), bool)  # windows inside one text
    lo, hi = block.offsets[:-1], block.offsets[1:]
    for a, b in zip(np.maximum(lo, hi - WINDOW + 1).tolist(), hi.tolist()):
        valid[a:b] = False
    starts_run = valid.copy()
    starts_run[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    ends_run = valid.copy()
    ends_run[:-1] &= (owner[1:] != owner[:-1]) | ~valid[1:]
    starts, ends = np.flatnonzero(starts_run), np.flatnonzero(ends_run) + 1
    anchors = owner[starts]
    return starts, ends, anchors, gram[anchors], prefix


def range_bits(docs: DataFrame) -> int:
    """Bits of the hash that cut the anchors of ``docs`` into ranges of bounded size, each of
    them whole bytes of the bitmap."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return min(max(RANGE_BITS, (chars // RANGE_CHARS).bit_length()), MAP_BITS - 3)


def anchor_map(docs: DataFrame, cut: int = RANGE_BITS) -> bytes:
    """Bitmap (by the top bits) of the anchors that two documents have; ``cut``: see
    ``range_bits``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for block in text_blocks(batch.column("text"), BLOCK_BYTES):
                starts, _, _, gram, _ = owned_runs(block)
                text = np.searchsorted(block.offsets, starts, "right").astype(np.uint64)
                # distinct per text: sort by (gram, text) and drop repeats
                order = np.lexsort((text, gram))
                gram, text = gram[order], text[order]
                keep = np.ones(len(gram), bool)
                keep[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                found.append(gram[keep])
                held += int(keep.sum())
                if held >= HELD_ROWS:
                    yield from emit(found)
                    found, held = [], 0
        if held:
            yield from emit(found)

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.unique(np.concatenate(found), return_counts=True)
        cuts = _range_cuts(grams, cut)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(1 << cut, dtype=np.int32)),
             binary_array([pack_integers(g) for g in np.split(grams, cuts)]),
             binary_array([np.packbits(c) for c in np.split(counts > 1, cuts)])],
            ["range", "grams", "again"])

    def merge(rows):
        grams = [unpack_integers(g, np.uint64) for g in rows["grams"]]
        again = [g[np.unpackbits(np.frombuffer(a, np.uint8))[:len(g)].astype(bool)]
                 for g, a in zip(grams, rows["again"])]
        merged = np.sort(np.concatenate(grams))
        repeated = np.concatenate([merged[1:][merged[1:] == merged[:-1]], *again])
        return rows[["range"]].head(1).assign(bits=[_cell_bits(repeated, cut)])

    parts = docs.select("text").mapInArrow(scan, "range int, grams binary, again binary")
    return _bitmap(parts.groupBy("range").applyInPandas(merge, "range int, bits binary"), cut)


def _range_cuts(grams: np.ndarray, cut: int) -> np.ndarray:
    """Where the 2^cut equal ranges of the hash begin in a sorted array (but the first)."""
    return np.searchsorted(grams, np.arange(1, 1 << cut, dtype=np.uint64) << np.uint64(64 - cut))


def _cell_bits(grams: np.ndarray, cut: int) -> bytes:
    """The part of a bitmap that belongs to one hash range, with these hashes marked."""
    bits = np.zeros(1 << (MAP_BITS - cut), bool)
    bits[(grams >> np.uint64(64 - MAP_BITS)).astype(np.int64) % len(bits)] = True
    return np.packbits(bits).tobytes()


def _bitmap(parts: DataFrame, cut: int) -> bytes:
    """The whole bitmap from the parts of its 2^cut ranges (16 MB, whatever the input)."""
    out = bytearray(1 << (MAP_BITS - 3))
    size = len(out) >> cut
    for row in parts.collect():
        out[row.range * size:(row.range + 1) * size] = row.bits
    return bytes(out)


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Are the hashes' cells marked?"""
    cell = (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def settle(docs: DataFrame, bitmap, cut: int = RANGE_BITS) -> tuple[DataFrame, bytes]:
    """(verdicts of anchors with one content, bitmap of the anchors with several); ``cut``:
    see ``range_bits``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block, row, starts, stops, _, gram, content in _marked_runs(batch, bits):
                windows = (stops - starts - WINDOW + 1).astype(np.uint8)
                held.append((gram, content, ids[row + block.first], windows))
                rows += len(gram)
                if rows >= HELD_ROWS:
                    yield emit(held)
                    held, rows = [], 0
        if rows:
            yield emit(held)

    def emit(held: list[tuple]) -> pa.RecordBatch:
        gram, content, ids, windows = (np.concatenate(x) for x in zip(*held))
        gram, content, low, high, pick = _distinct(gram, content, ids, ids)
        cuts = _range_cuts(gram, cut)

        def parts(values: np.ndarray, pack) -> pa.Array:
            return binary_array([pack(v) for v in np.split(values, cuts)])

        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(1 << cut, dtype=np.int32)), parts(gram, pack_integers),
             parts(content, lambda v: v), parts(low, pack_integers), parts(high - low, pack_integers),
             parts(windows[pick], lambda v: v)], ["range", "grams", "contents", "low", "span", "windows"])

    def merge(table):
        def column(name: str, read) -> np.ndarray:
            return np.concatenate([read(v) for v in table.column(name).to_pylist()])

        low = column("low", lambda v: unpack_integers(v, np.int64))
        span = column("span", lambda v: unpack_integers(v, np.int64))
        gram, content, low, high, pick = _distinct(
            column("grams", lambda v: unpack_integers(v, np.uint64)),
            column("contents", lambda v: np.frombuffer(v, np.uint64)), low, low + span)
        windows = column("windows", lambda v: np.frombuffer(v, np.uint8))[pick]
        new = np.append(True, gram[1:] != gram[:-1]) if len(gram) else np.zeros(0, bool)
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(gram) else new
        done = ~several & (low < high)
        n = int(done.sum())
        where = table.column("range")[0].as_py()

        def after_bits(values: np.ndarray) -> pa.Array:  # the first row has the bits only
            return pa.array(np.append(values.dtype.type(0), values))

        return pa.table({
            "range": pa.array(np.full(n + 1, where, np.int32)),
            "bits": pa.concat_arrays([pa.array([_cell_bits(gram[several], cut)], pa.binary()),
                                      pa.nulls(n, pa.binary())]),
            "anchor": after_bits(gram[done].view(np.int64)),
            "content": after_bits(content[done].view(np.int64)),
            "from": pa.array(np.zeros(n + 1, np.int32)),
            "to": after_bits(windows[done].astype(np.int32)),
            "least": after_bits(low[done])})

    sent = docs.mapInArrow(
        scan, "range int, grams binary, contents binary, low binary, span binary, windows binary")
    merged = written(sent.groupBy("range").applyInArrow(
        merge, "range int, bits binary, anchor long, content long, `from` int, `to` int, least long"),
        "settled")
    told = merged.where("bits is null").select("anchor", "content", "from", "to", "least")
    return told, _bitmap(merged.where("bits is not null").select("range", "bits"), cut)


def _distinct(gram, content, low, high):
    """Distinct (gram, content), sorted, with their extreme documents and a row of each."""
    order = np.lexsort((low, content, gram))
    g, c = gram[order], content[order]
    head = np.ones(len(order), bool)
    head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    heads = np.flatnonzero(head)
    top = np.maximum.reduceat(high[order], heads) if len(heads) else high[:0]
    return g[heads], c[heads], low[order][heads], top, order[heads]


def _marked_runs(batch: pa.RecordBatch, bits: np.ndarray):
    """Per block: (block, row of each run, position in its text, hashes ...) of marked anchors."""
    for block in text_blocks(batch.column("text"), BLOCK_BYTES):
        starts, ends, anchors, gram, _ = owned_runs(block)
        hit = _in_map(bits, gram)
        starts, ends, anchors, gram = starts[hit], ends[hit], anchors[hit], gram[hit]
        if not len(starts):
            continue
        stops = ends + WINDOW - 1
        content = mix(block.hashes(starts, stops) + (anchors - starts).astype(np.uint64))
        row = np.searchsorted(block.offsets, starts, "right") - 1
        yield block, row, starts, stops, anchors, gram, content


def content_map(told: DataFrame, cut: int = RANGE_BITS) -> bytes:
    """Bitmap (by the top bits) of the contents that have a verdict; ``cut``: see
    ``range_bits``."""

    def merge(rows):
        return rows[["range"]].head(1).assign(
            bits=[_cell_bits(rows["content"].to_numpy().view(np.uint64), cut)])

    # one content per cell is enough, so a range holds at most its share of the cells
    cells = told.groupBy(F.shiftrightunsigned("content", 64 - MAP_BITS)).agg(F.first("content").alias("content"))
    ranges = F.shiftrightunsigned("content", 64 - cut).cast("int").alias("range")
    return _bitmap(cells.select(ranges, "content").groupBy("range").applyInPandas(
        merge, "range int, bits binary"), cut)


def occurrences(docs: DataFrame, bitmap, contents_bitmap) -> DataFrame:
    """(anchor, content, doc_id, text_key, at) of every run with a marked anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        wanted = np.frombuffer(contents_bitmap.value, np.uint8)
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for block, row, starts, _, _, gram, content in _marked_runs(batch, bits):
                hit = _in_map(wanted, content)
                row, starts, gram, content = row[hit], starts[hit], gram[hit], content[hit]
                of = pa.array(row + block.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)),
                     ids.take(of), keys.take(of),
                     pa.array((starts - block.offsets[row]).astype(np.int32))],
                    ["anchor", "content", "doc_id", "text_key", "at"])

    return docs.mapInArrow(run, "anchor long, content long, doc_id long, text_key int, at int")


def contents(docs: DataFrame, bitmap) -> DataFrame:
    """Distinct contents of each task: anchor, content, low and high doc_id, anchor's
    place, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        held: list[tuple] = []
        rows = 0

        def emit() -> pa.RecordBatch:
            gram, content, ids, place, length, pieces = (np.concatenate(x) for x in zip(*held))
            begins = np.cumsum(length) - length
            gram, content, low, high, pick = _distinct(gram, content, ids, ids)
            taken = [pieces[b:b + n].tobytes() for b, n in zip(begins[pick].tolist(), length[pick].tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(low), pa.array(high),
                 pa.array(place[pick].astype(np.int32)), pa.array(taken, pa.binary())],
                ["anchor", "content", "low", "high", "place", "bytes"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block, row, starts, stops, anchors, gram, content in _marked_runs(batch, bits):
                length = stops - starts
                offsets = np.cumsum(length) - length
                inside = np.arange(int(length.sum())) + np.repeat(starts - offsets, length)
                held.append((gram, content, ids[row + block.first], anchors - starts, length,
                             block.data[inside]))
                rows += len(gram)
                if rows >= 500_000:
                    yield emit()
                    held, rows = [], 0
        if rows:
            yield emit()

    return docs.mapInArrow(run, "anchor long, content long, low long, high long, place int, bytes binary")


class Suffixes:
    """Suffixes of a buffer, cut to WINDOW bytes and compared through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.block = TextBlock(data, np.array([0, len(data)]))
        self.prefix = self.block.prefix_hash()

    def windows(self, a: np.ndarray) -> np.ndarray:
        """Hashes of the whole windows at a."""
        return self.block.span_hash(self.prefix, a, a + WINDOW)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes a and b (by binary search)."""
        whole = self.windows(a) == self.windows(b)
        low = np.where(whole, WINDOW, 0)
        high = np.where(whole, WINDOW, WINDOW - 1)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = (self.block.span_hash(self.prefix, a, a + middle)
                    == self.block.span_hash(self.prefix, b, b + middle))
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Is suffix a less than (or equal to) suffix b?"""
        n = self.common(a, b)
        whole = n >= WINDOW
        step = np.minimum(n, WINDOW - 1)
        less = self.data[a + step] < self.data[b + step]
        return np.where(whole, or_equal, less)


def merge_sort(suffixes: Suffixes, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``starts`` that sorts each run of equal ``segment`` (already
    contiguous): bottom-up merges, all pairs of runs of a level at once."""
    n = len(starts)
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if n else order
    sizes = np.diff(np.append(first, n))
    base = np.repeat(first, sizes)           # where the element's segment begins
    size = np.repeat(sizes, sizes)
    local = np.arange(n) - base
    width = 1
    while n and width < sizes.max():
        pair = local // (2 * width) * (2 * width)
        middle, end = np.minimum(pair + width, size), np.minimum(pair + 2 * width, size)
        moving = np.flatnonzero(middle < end)  # pairs with two runs
        left = local[moving] < middle[moving]
        b = base[moving]
        lo = np.where(left, middle[moving], pair[moving]) + b
        hi = np.where(left, end[moving], middle[moving]) + b
        other = lo.copy()
        own = starts[order[moving]]
        while True:  # elements of the other run that come before: binary search
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            probe = starts[order[mid]]
            # a left element precedes equal right ones, so the sort is stable
            is_left = left[open_]
            goes = np.where(is_left, suffixes.before(probe, own[open_], False),
                            suffixes.before(probe, own[open_], True))
            lo[open_] = np.where(goes, mid + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], mid)
        passed = lo - other
        own_rank = local[moving] - np.where(left, pair[moving], middle[moving])
        target = b + pair[moving] + own_rank + passed
        merged = order.copy()
        merged[target] = order[moving]
        order = merged
        width *= 2
    return order


def least_documents(anchor: np.ndarray, place: np.ndarray, low: np.ndarray, pieces: list[bytes]):
    """(content row, window, smallest document) for every window of the contents."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(lengths) - lengths
    windows = lengths - WINDOW + 1
    row = np.repeat(np.arange(len(pieces)), windows)
    window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    least = low[row].copy()
    # equal windows have the same anchor at the same distance, and the same hash: windows
    # of other hashes need not be told apart by sorting them
    suffixes = Suffixes(data)
    distance, whole = place[row] - window, suffixes.windows(begins[row] + window)
    order = np.lexsort((whole, distance, anchor[row]))
    a, d, h = anchor[row][order], distance[order], whole[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    segment = np.cumsum(new)
    shared = np.bincount(segment)[segment] > 1  # windows alone in their segment stand
    todo, segment = order[shared], segment[shared]
    if len(todo):
        starts = begins[row[todo]] + window[todo]
        ranked = merge_sort(suffixes, starts, segment)
        s, g = starts[ranked], segment[ranked]
        same = np.zeros(len(s), bool)
        near = np.flatnonzero(g[1:] == g[:-1])
        equal = suffixes.common(s[near], s[near + 1]) >= WINDOW
        near = near[equal]
        for step in range(WINDOW):  # verification of the bytes behind equal hashes
            near = near[data[s[near] + step] == data[s[near + 1] + step]]
        same[near + 1] = True
        of = np.cumsum(~same) - 1
        smallest = np.full(of[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, of, low[row[todo]][ranked])
        least[todo[ranked]] = smallest[of]
    return row, window, least


def verdicts(found: DataFrame, parts: int) -> DataFrame:
    """(anchor, content, from, to, least): windows from..to-1 of a content occur first in
    document ``least``; runs that no document of the content can use are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by anchor: whole anchors, a bounded number at a time
        held, rows = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch)
                rows += len(batch)
                if rows * 20 < SORT_ROWS:
                    break
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if cut:
                    yield from solve(table.slice(0, cut))
                rest = table.slice(cut).to_batches()
                held, rows = rest, len(table) - cut
                break
        if rows:
            yield from solve(pa.Table.from_batches(held))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor, content, low, high, place = (
            table.column(c).to_numpy() for c in ("anchor", "content", "low", "high", "place"))
        # the same content from several tasks: one row, with its extreme documents
        anchor, content, low, top, pick = _distinct(anchor, content, low, high)
        place = place[pick]
        pieces = table.column("bytes").take(pa.array(pick)).to_pylist()
        row, window, least = least_documents(anchor, place, low, pieces)
        useful = least < top[row]
        joined = np.zeros(len(row), bool)
        joined[1:] = (row[1:] == row[:-1]) & (least[1:] == least[:-1])
        begin = np.flatnonzero(~joined)
        end = np.append(begin[1:], len(row)) - 1
        keep = useful[begin]
        begin, end = begin[keep], end[keep]
        of = row[begin]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[of]), pa.array(content[of]), pa.array(window[begin].astype(np.int32)),
             pa.array((window[end] + 1).astype(np.int32)), pa.array(least[begin])],
            ["anchor", "content", "from", "to", "least"])

    return (found.repartition(parts, "anchor").sortWithinPartitions("anchor")
            .mapInArrow(run, "anchor long, content long, `from` int, `to` int, least long"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, from, to): byte ranges to remove; they may overlap or touch."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("text_key"))
    context = spark.sparkContext
    cut = range_bits(rows)
    marked = context.broadcast(anchor_map(rows, cut))
    told, several = settle(rows, marked, cut)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = written(told.unionByName(verdicts(contents(rows, context.broadcast(several)), parts)), "told")
    wanted = context.broadcast(content_map(told, cut))
    hits = occurrences(rows, marked, wanted).join(told, ["anchor", "content"]).where("least < doc_id")
    return hits.select("doc_id", "text_key", (F.col("at") + F.col("from")).alias("from"),
                       (F.col("at") + F.col("to") + (WINDOW - 1)).alias("to"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (array of spans), kept (binary) for every row."""
    per_doc = removed_spans(docs).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("from", "to")).alias("spans"))  # at most the text's length

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block in text_blocks(batch.column("text"), BLOCK_BYTES):
                n = len(block)
                texts = [pack.compress(block.text_bytes(i)) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, n),
                     batch.column("text_key").slice(block.first, n), pa.array(texts, pa.binary())],
                    ["doc_id", "text_key", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sizes, spans_out, kept_out = [], [], []
                for packed, spans in zip(part.column("packed"), part.column("spans")):
                    text = unpack.decompress(packed.as_py())
                    merged = _merge(spans.as_py() or [])
                    edges = [0, *(x for span in merged for x in span), len(text)]
                    kept_out.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    spans_out.append([{"from": a, "to": b} for a, b in merged])
                    sizes.append(len(text))
                kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans_out, kind),
                     pa.array(kept_out, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.hash("text").alias("text_key")).mapInArrow(
        squeeze, f"doc_id {doc_type}, text_key int, packed binary")
    return texts.join(per_doc, ["doc_id", "text_key"], "left").mapInArrow(
        cut, f"doc_id {doc_type}, n_bytes long, removed array<struct<`from`: int, `to`: int>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    done = dedup_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return done.select("doc_id", "n_bytes", lost.alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))
