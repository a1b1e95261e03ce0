"""Benchmark decontamination by template canonicalisation.

Words are turned into template tokens: numbers become ``NUM`` (with an
attached or following unit as ``UNIT``), capitalised words that do not open a
sentence become ``NAME``, every other word is its lower-cased letters and
digits. The value behind a placeholder is its slot value. Windows of ``width``
tokens are hashed (items with fewer tokens are one window) and joined:
document windows that pass a fixed-size filter of benchmark hashes meet the
benchmark's windows in a hash join. Every window of an item is sought in the
readings that can say something about it:

- plain: only numbers are placeholders. What stands before the window, and
  the case of its letters, do not matter;
- raw: the words themselves, for windows of which more than half are numbers;
- sum: numbers are placeholders that name the operators before them, for windows
  mostly of numbers that have two other words and an operator between numbers, so
  that a calculation is found with other values but the same operators;
- template: names and units are placeholders too, if at least half of the
  window is literal. Whether the first word is a name or a unit depends on
  what stands before it, so an item's window has both readings of that word.

Matched windows of one document and item with the same shift form an
alignment. In an alignment every slot value of the item must stand for one
value of the document; windows that contradict the most frequent binding of a
value are dropped (slot consistency), the others cover the item. An item leaks
into a document when one alignment covers at least half of the item's tokens,
or ``min_tokens`` of them.

An item of fewer than ``MIN_ITEM`` words, which ordinary text contains, is sought as
whole sentences, lines or a whole text with the same words: its copy begins and
ends where a sentence does.

Defined results: null or empty texts, of documents or items, match nothing, and
so do items without a letter or digit. A text is read whole, however long (in one
block of its own beyond 4 MB). A
null doc_id or item_id can match and is returned as null. Repeated rows count
once per doc_id and item_id. Empty tables give an empty result. Only
``doc_id`` and ``text`` (``item_id`` and ``text``) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.deploy import free_name, ship_package, written
from wardline.llm.textblocks import TextBlock, mix, text_blocks, window_hashes

WIDTH = 10
MIN_TOKENS = 13
MIN_ITEM = 5
FILTER_BITS = 22

# Unit words recognised after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs day days week weeks"
         " month months year years hz khz mhz ghz w kw mw v a k c f bytes kb mb gb tb pct percent"
         " usd eur gbp dollars euros pounds cents meters metres miles liters litres hours minutes"
         " seconds").split()

_KIND = {"NUM": 1, "NAME": 2, "UNIT": 3}


def _hash_of(text: str) -> int:
    block = TextBlock(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    h = block.span_hash(block.prefix_hash(), np.array([0]), np.array([len(block.data)]))
    return int(mix(h)[0])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CORE = np.zeros(256, bool)  # bytes of a word's core: letters, digits, non-ASCII
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CLOSES = np.zeros(256, bool)  # bytes that end a sentence
_CLOSES[[33, 46, 63, 58]] = True
_ENDS = _SPACE.copy()  # bytes that may follow such a mark: spaces, quotes, brackets, marks
_ENDS[[33, 34, 39, 41, 46, 58, 63, 93, 125]] = _ENDS[128:] = True
_OPERATOR = np.zeros(256, bool)  # bytes of operators: % * + - / < = > ^
_OPERATOR[[37, 42, 43, 45, 47, 60, 61, 62, 94]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


_MARKS = mix(np.arange(4, dtype=np.uint64) + np.uint64(77))  # tokens of the placeholders


def _core(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of words' cores, bytes that part words as a space does: dashes, hard
    spaces). Quotes and other punctuation beyond ASCII are no letters."""
    core, parts = _CORE[data], np.zeros(len(data), bool)
    second, third = data[1:-1], data[2:]
    mark = np.flatnonzero((data[:-2] == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third < 0xB0))))
    dash = mark[(data[mark + 1] == 0x80) & (data[mark + 2] >= 0x93) & (data[mark + 2] <= 0x95)]
    for k in range(3):
        core[mark + k] = False
        parts[dash + k] = True
    mark = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], (0xA0, 0xA1, 0xAB, 0xAD, 0xBB, 0xBF)))
    hard = mark[data[mark + 1] == 0xA0]
    for k in range(2):
        core[mark + k] = False
        parts[hard + k] = True
    return core, parts


class Templates:
    """Tokens of a block: the hash of every word (``value``), the template's ``token``
    (literals, or placeholders) and ``slot`` kinds, the ``plain`` tokens in which only
    a ``number`` is a placeholder, the ``sums`` tokens in which it names the operators
    before it (``operator``: there are any, after another number), words that may be
    names (``capital``) or units (``unit``) by themselves, words that open a sentence
    (``opens``), and token offsets per text."""

    def __init__(self, block: TextBlock, unit_hashes: np.ndarray):
        data = block.data
        core, parts = _core(data)
        starts, ends, _ = block.spans(~_SPACE[data] & ~parts)
        positions = np.concatenate(([0], np.cumsum(core)))
        has = positions[ends] > positions[starts]
        starts, ends = starts[has], ends[has]
        # hash of the core bytes only, lower-cased: punctuation does not matter
        kept = np.flatnonzero(core)
        letters = _FOLD[data[kept]]
        wide = np.flatnonzero((letters[:-1] == 0xC3) & (letters[1:] >= 0x80) & (letters[1:] <= 0x9E)
                              & (letters[1:] != 0x97)) + 1
        letters[wide] += 32  # the capitals of Latin-1
        folded = TextBlock(letters, np.array([0, len(kept)]))
        lo, hi = positions[starts], positions[ends]
        word = mix(folded.span_hash(folded.prefix_hash(), lo, hi))
        first_core = data[kept[lo]] if len(lo) else np.zeros(0, np.uint8)
        offsets = np.searchsorted(starts, block.offsets)
        opens = np.zeros(len(starts), bool)  # the word opens a text or a sentence
        if len(starts):
            opens[offsets[:-1][offsets[:-1] < len(starts)]] = True
            marks = (data == 10) | (_CLOSES[data] & _ENDS[np.append(data[1:], 32)])
            closing = np.concatenate(([0], np.cumsum(marks)))
            # a closing mark after the letters of the word before, or a line end between them
            opens[1:] |= closing[starts[1:]] > closing[kept[hi[:-1] - 1] + 1]
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data[kept]] if len(kept) else kept)))
        # a multi-byte capital (0xC3 0x80..0x9E) is a capital too
        second = data[np.minimum(kept[lo] + 1, len(data) - 1)] if len(lo) else first_core
        capital = _UPPER[first_core] | ((first_core == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        is_number = _DIGIT[first_core] if len(lo) else np.zeros(0, bool)
        number_only = is_number & (digits[hi] - digits[lo] == hi - lo)
        attached = is_number & ~number_only  # 12km: a number with its unit
        after_number = np.concatenate(([False], number_only[:-1])) if len(lo) else number_only
        after_number[offsets[:-1][offsets[:-1] < len(starts)]] = False
        self.number, self.unit = is_number, np.isin(word, unit_hashes)
        self.capital = capital & ~is_number
        is_unit = after_number & self.unit
        is_name = self.capital & ~opens & ~is_unit
        self.slot = np.where(number_only | attached, _KIND["NUM"], np.where(
            is_unit, _KIND["UNIT"], np.where(is_name, _KIND["NAME"], 0))).astype(np.int8)
        self.value = word
        self.token = np.where(self.slot > 0, _MARKS[self.slot], word)
        self.plain = np.where(is_number, _MARKS[_KIND["NUM"]], word)
        self.offsets, self.opens = offsets, opens
        # operators between the letters of a number and those of the number before it
        marks = np.flatnonzero(_OPERATOR[data])
        follows = np.zeros(len(starts), bool)
        follows[1:] = is_number[1:] & is_number[:-1] & ~opens[1:]
        names, self.operator = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
        if len(starts):
            owner = np.searchsorted(kept[lo], marks, "right")  # the word after the mark
            after = np.concatenate(([0], kept[hi - 1] + 1))[owner]
            between = (owner < len(starts)) & (marks >= after)
            marks, owner = marks[between], owner[between]
            marks, owner = marks[follows[owner]], owner[follows[owner]]
            self.operator[owner] = True
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)  # 1st, 2nd, ... mark of its word
            np.add.at(names, owner, mix((data[marks] + 256 * (rank + 1)).astype(np.uint64)))
        self.sums = np.where(is_number, mix(_MARKS[_KIND["NUM"]] + names), word)

    def whole(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether windows that begin ``at`` are whole sentences, lines or texts."""
        after = at + size
        ends = np.append(self.opens, True)[np.minimum(after, len(self.opens))]
        return self.opens[at] & (ends | np.isin(after, self.offsets))


def item_readings(block: TextBlock, width: int, units: np.ndarray):
    """Yields (text, hash, at, size, tokens of the text, slots) for all readings of all
    windows of the texts (see the module)."""
    t = Templates(block, units)
    for i, (lo, hi) in enumerate(zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist())):
        size = min(hi - lo, width)
        if not size:
            continue
        if size < MIN_ITEM:
            here = slice(lo, hi)
            yield i, window_hashes(t.value[here], size)[0], 0, size, size, _slots(t.number[here], t.value[here])
            continue
        sums = window_hashes(t.sums[lo:hi], size)
        plain, raw = window_hashes(t.plain[lo:hi], size), window_hashes(t.value[lo:hi], size)
        for at in range(hi - lo - size + 1):
            here = slice(lo + at, lo + at + size)
            number = t.number[here]
            poor = 2 * number.sum() > size
            yield i, (raw if poor else plain)[at], at, size, hi - lo, _slots(number, t.value[here])
            if poor and size - number.sum() >= 2 and t.operator[here][1:].any():
                yield i, sums[at], at, size, hi - lo, _slots(number, t.value[here])
            first = {int(t.slot[lo + at])}
            if not number[0]:
                first.add(0)
                if t.capital[lo + at]:
                    first.add(_KIND["NAME"])
                if t.unit[lo + at]:
                    first.add(_KIND["UNIT"])
            for kind in sorted(first):
                slot = t.slot[here].copy()
                slot[0] = kind
                if (slot > _KIND["NUM"]).any() and 2 * (slot > 0).sum() <= size:
                    token = np.where(slot > 0, _MARKS[slot], t.value[here])
                    yield i, window_hashes(token, size)[0], at, size, hi - lo, _slots(slot, t.value[here])


WINDOW_SCHEMA = "hash long, at int, size int, n_tokens int, slots array<long>"


def _unit_hashes() -> np.ndarray:
    return np.array([_hash_of(u) for u in UNITS], np.uint64)


def _slots(slot: np.ndarray, value: np.ndarray) -> list[int]:
    """Slot values of a window as place, value, place, value, ..."""
    places = np.flatnonzero(slot)
    values = value[places].view(np.int64)
    return np.column_stack((places, values)).reshape(-1).tolist()


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """All readings of the items' windows: item_id, hash, at, size, n_tokens, slots."""
    item_type = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_hashes()
        for batch in batches:
            for block in text_blocks(batch.column("text")):
                items, rows = [], []
                for i, h, at, size, n_tokens, slots in item_readings(block, width, units):
                    items.append(block.first + i)
                    rows.append((int(h.astype(np.int64)), at, size, n_tokens, slots))
                if rows:
                    names = ["hash", "at", "size", "n_tokens", "slots"]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(items)), *columns],
                        ["item_id", *names])

    return benchmark.select("item_id", "text").mapInArrow(
        run, f"item_id {item_type}, {WINDOW_SCHEMA}")


def hash_filter(items: DataFrame) -> bytes:
    """A bitmap of 2**FILTER_BITS bits (512 KB) with the top bits of every hash."""
    cell = F.shiftrightunsigned(F.col("hash"), 64 - FILTER_BITS) + F.lit(1)
    rows = items.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    out = bytearray(1 << (FILTER_BITS - 3))
    for row in rows:
        at = (row.bucket - 1) * 4096
        out[at:at + 4096] = row.bits
    return bytes(out)


def document_windows(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """Windows of the documents that may be in the benchmark: doc_id, hash, at, slots.
    ``sizes``: the window sizes in use (the width, and the lengths of shorter items)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_hashes()
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            owners, hashes_out, at_out, size_out, slots_out = [], [], [], [], []
            for block in text_blocks(batch.column("text")):
                t = Templates(block, units)
                for size in sizes:
                    plain = window_hashes(t.plain, size)
                    readings = ((t.plain, t.number), (t.token, t.slot), (t.value, t.number), (t.sums, t.number))
                    if size < MIN_ITEM:
                        readings = ((t.value, t.number),)
                    for tokens, slot in readings:
                        windows = plain if tokens is t.plain else window_hashes(tokens, size)
                        hit = wanted[(windows >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                        if tokens is not t.plain and size >= MIN_ITEM:
                            hit &= windows != plain
                        hit = np.flatnonzero(hit)
                        if size < MIN_ITEM:
                            hit = hit[t.whole(hit, size)]
                        text = np.searchsorted(t.offsets, hit, "right") - 1
                        inside = hit + size <= t.offsets[text + 1]
                        for w, i in zip(hit[inside].tolist(), text[inside].tolist()):
                            owners.append(block.first + i)
                            hashes_out.append(int(windows[w].astype(np.int64)))
                            at_out.append(w - int(t.offsets[i]))
                            size_out.append(size)
                            slots_out.append(_slots(slot[w:w + size], t.value[w:w + size]))
            if owners:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owners)), pa.array(hashes_out, pa.int64()),
                     pa.array(at_out, pa.int32()), pa.array(size_out, pa.int32()),
                     pa.array(slots_out, pa.list_(pa.int64()))],
                    ["doc_id", "hash", "at", "size", "slots"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, hash long, at int, size int, slots array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
               min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, item_id, n_windows, n_covered (item tokens covered by the best
    alignment), n_tokens (of the item), one row per leaked pair."""
    items = written(item_windows(benchmark, width), "items").distinct()
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # at most `width` values
    doc_rows = document_windows(docs, hash_filter(items), sizes)
    left = doc_rows.select("doc_id", "hash", F.col("at").alias("doc_at"), "size",
                           F.col("slots").alias("doc_slots"))
    pairs = left.join(items, ["hash", "size"]).select(
        "doc_id", "item_id", (F.col("doc_at") - F.col("at")).alias("shift"), "at", "size", "n_tokens",
        "slots", "doc_slots").distinct()
    pairs = written(pairs, "windows")
    # one row per slot of a matched window, in however many readings it matched; the
    # places agree, as the tokens do
    place = F.sequence(F.lit(0), (F.size("slots") / 2 - 1).cast("int"))
    slots = pairs.where(F.size("slots") > 0).select(
        "doc_id", "item_id", "shift", "at", F.explode(place).alias("k"), "slots", "doc_slots").select(
        "doc_id", "item_id", "shift", "at", F.element_at("slots", F.col("k") * 2 + 1).alias("place"),
        F.element_at("slots", F.col("k") * 2 + 2).alias("item_value"),
        F.element_at("doc_slots", F.col("k") * 2 + 2).alias("doc_value")).distinct()
    key = ["doc_id", "item_id", "shift"]
    bound = slots.groupBy(*key, "item_value", "doc_value").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*key, "item_value").orderBy(F.col("n").desc(), "doc_value")
    wrong = bound.withColumn("rank", F.row_number().over(best)).where("rank > 1").drop("rank", "n")
    contradicted = _join(slots, wrong, [*key, "item_value", "doc_value"], "left_semi").select(
        *key, "at").distinct()
    good = _join(pairs, contradicted, [*key, "at"], "left_anti")
    covered = good.select(*key, "n_tokens", F.explode(
        F.sequence("at", F.col("at") + F.col("size") - 1)).alias("token"), "at")
    found = covered.groupBy(*key).agg(
        F.count_distinct("token").alias("n_covered"), F.count_distinct("at").alias("n_windows"),
        F.max("n_tokens").alias("n_tokens"))
    found = found.where((F.col("n_covered") * 2 >= F.col("n_tokens")) | (F.col("n_covered") >= min_tokens))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_covered", "n_windows", "n_tokens")).alias("best")).select(
        "doc_id", "item_id", F.col("best.n_windows").alias("n_windows"),
        F.col("best.n_covered").cast("long").alias("n_covered"), F.col("best.n_tokens").alias("n_tokens"))


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join in which null keys are equal."""
    names = {k: free_name(left, f"{k}_right") for k in keys}
    right = right.select(*[F.col(k).alias(n) for k, n in names.items()])
    on = None
    for k, n in names.items():
        same = F.col(k).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return left.join(right, on, how)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) into which no item leaks. The leaked ids are stored,
    so that the join is planned by their size: a few are broadcast and no text is shuffled."""
    leaked = written(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaked")
    return _join(docs, leaked, ["doc_id"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
