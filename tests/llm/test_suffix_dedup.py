import random

import numpy as np
import pytest

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import suffix_dedup as S


def brute(rows):
    """doc_id -> (n_bytes, spans, kept): every 50-byte string looked up among smaller documents."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        mine = [data[i:i + 50] for i in range(len(data) - 49)]
        for i, w in enumerate(mine):
            if w in first:
                gone[i + 1:i + 51] = True
        for w in mine:
            first.setdefault(w, doc_id)
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        kept = bytes(b for b, g in zip(data, gone[1:]) if not g)
        out[doc_id] = (len(data), list(zip(edges[::2].tolist(), edges[1::2].tolist())), kept)
    return out


def check(make_docs, rows):
    got = {r.doc_id: (r.n_bytes, [(s["from"], s["to"]) for s in r.removed], bytes(r.kept))
           for r in S.dedup_text(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_passages_copies_and_edits(make_docs, words):
    passage, base = words(40, 1), words(100, 2)
    rows = [(i, words(20, 10 + i) + " " + passage + " " + words(20, 60 + i)) for i in range(25)]
    rows += [(100 + i, base) for i in range(5)]
    rows += [(200 + i, base[:30 * i] + "#" + base[30 * i:]) for i in range(12)]
    rows += [(300, base[:49]), (301, base[:50]), (302, base[1:51]), (303, passage * 3), (304, passage[10:] * 2)]
    check(make_docs, rows)


@pytest.mark.parametrize("seed", range(3))
def test_low_entropy_texts(make_docs, seed):
    """Few letters and runs: windows repeat inside and across documents, with many ties."""
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) * rng.randint(1, 3)) for i in range(25)]
    rows += [(50 + i, "a" * n + "b" * m) for i, (n, m) in enumerate([(49, 0), (50, 0), (51, 3), (120, 60), (60, 120)])]
    rows += [(70, "éà" * 60), (71, "xéà" + "éà" * 40), (72, "à" + "éà" * 30)]
    check(make_docs, rows)


def test_every_window_has_one_owner():
    rng = np.random.default_rng(0)
    from wardline.llm.textblocks import TextBlock
    data = rng.integers(97, 100, 600).astype(np.uint8)
    block = TextBlock(data, np.array([0, 30, 200, 200, 249, 600]))
    starts, ends, anchors, _, _ = S.owned_runs(block)
    covered = sorted(w for a, b in zip(starts, ends) for w in range(a, b))
    assert covered == [*range(30, 151), *range(249, 551)]
    assert all(a <= k and k + S.GRAM <= a + 50 and k >= b - 1 for a, b, k in zip(starts, ends, anchors))


def test_sort_orders_suffixes_and_sees_through_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.permutation(3900)[:500]
    segment = np.sort(rng.integers(0, 20, 500))
    order = S.merge_sort(S.Suffixes(data), starts, segment)
    text = data.tobytes()
    for g in range(20):
        members = starts[order][segment == g]
        texts = [text[s:s + 50] for s in members]
        assert texts == sorted(texts) and sorted(members) == sorted(starts[segment == g])
    # a hash that calls everything equal must not merge different windows
    monkeypatch.setattr(S.Suffixes, "common", lambda self, a, b: np.full(len(a), S.WINDOW))
    pieces = [b"a" * 50, b"b" * 50, b"a" * 50]
    _, _, least = S.least_documents(np.zeros(3, np.int64), np.zeros(3, np.int64), np.array([5, 1, 3]), pieces)
    assert least[1] == 1 and 1 not in (least[0], least[2])


def test_nulls_repeats_and_empty_tables(make_docs, words):
    text = words(40, 3)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    check(make_docs, rows)
    out = S.dedup_text(make_docs([(None, text), (4, text), (4, text + " x"), (9, text)])).collect()
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in out)
    n = len(text)
    assert got == [("4", n, n), ("4", n + 2, n + 2), ("9", n, 0), ("None", n, n)]
    assert S.dedup_text(make_docs([])).collect() == []


def test_a_scan_works_on_small_slices():
    """Working arrays stay far below the size of a batch of texts (several hundred MB before)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from wardline.llm.suffix_dedup import owned_runs
    from wardline.llm.textblocks import text_blocks

    letters = np.random.default_rng(5).integers(97, 123, 2000, dtype=np.uint8).tobytes().decode()
    texts = pa.array([letters] * 4000)  # 8 MB
    tracemalloc.start()
    try:
        runs = sum(len(owned_runs(block)[0]) for block in text_blocks(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert runs >= 4000 and peak < 150e6, peak


def test_unlike_windows_of_an_anchor_are_not_sorted(monkeypatch):
    import numpy as np

    from wardline.llm import suffix_dedup as S

    rng = np.random.default_rng(3)
    pieces = [rng.integers(97, 123, 60, dtype=np.uint8).tobytes() for _ in range(300)]
    pieces.append(pieces[7][:55] + b"?????")
    sorted_rows = []
    whole = S.merge_sort
    monkeypatch.setattr(S, "merge_sort", lambda s, starts, segment: (
        sorted_rows.append(len(starts)), whole(s, starts, segment))[1])
    n = len(pieces)
    row, window, least = S.least_documents(
        np.ones(n, np.uint64), np.full(n, 20), np.arange(n, dtype=np.int64) + 100, pieces)
    assert sum(sorted_rows) == 12  # six windows in common, twice
    assert least[(row == n - 1)].tolist() == [107] * 6 + [100 + n - 1] * 5


def test_settings_of_the_operators_leave_those_of_the_session(spark):
    from wardline.llm import deploy

    old = {k: spark.conf.get(k, None) for k in deploy.SETTINGS}
    first = next(iter(deploy.SETTINGS))
    try:
        spark.conf.set(first, "12345")
        deploy.ship_package(spark)
        assert spark.conf.get(first).startswith("12345")
        spark.conf.unset(first)
        deploy.ship_package(spark)
        assert {k: spark.conf.get(k) for k in deploy.SETTINGS} == deploy.SETTINGS
        rows = spark.range(100).distinct()
        assert sorted(rows.collect()) == sorted(rows.collect())  # its shuffle is made again
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_occurrences_with_a_verdict_are_sent(make_docs, words):
    """Short phrases in many documents mark anchors; only repeated windows are shuffled."""
    from wardline.llm import suffix_dedup as S

    phrase, passage = "the same thirty-two byte phrase", words(40, 1)
    assert len(phrase) < S.WINDOW
    rows = [(i, f"{words(15, 200 + i)} {phrase} {words(15, 400 + i)}") for i in range(60)]
    rows += [(100 + i, f"{words(15, 600 + i)} {passage}") for i in range(3)]
    docs = make_docs(rows).selectExpr("doc_id", "text", "hash(text) text_key")
    context = docs.sparkSession.sparkContext
    marked = context.broadcast(S.anchor_map(docs))
    told, several = S.settle(docs, marked)
    told = told.unionByName(S.verdicts(S.contents(docs, context.broadcast(several)), 4))
    sent = S.occurrences(docs, marked, context.broadcast(S.content_map(told)))
    every = S.occurrences(docs, marked, context.broadcast(b"\xff" * (1 << S.MAP_BITS - 3)))
    met = every.join(told, ["anchor", "content"], "left_semi").count()
    assert met == sent.count() < every.count() - 60
    assert {r.doc_id for r in sent.collect()} == {100, 101, 102}
    check(make_docs, rows)


def test_ranges_of_anchors_grow_with_the_input(make_docs, words, monkeypatch):
    """One merge holds a bounded part of the anchors, whatever the size of the corpus."""
    passage = words(60, 1)
    rows = [(i, f"{words(60, 100 + i)} {passage if i % 3 else ''} {words(20, 300 + i)}") for i in range(40)]
    docs = make_docs(rows).selectExpr("doc_id", "text", "hash(text) text_key")
    assert S.range_bits(docs) == S.RANGE_BITS
    monkeypatch.setattr(S, "RANGE_CHARS", 64)
    cut = S.range_bits(docs)
    assert 64 << cut > sum(len(t) for _, t in rows) and cut > S.RANGE_BITS
    context = docs.sparkSession.sparkContext
    marked = S.anchor_map(docs, cut)
    assert marked == S.anchor_map(docs) and any(marked)
    told, several = S.settle(docs, context.broadcast(marked), cut)
    same, again = S.settle(docs, context.broadcast(marked))
    assert several == again and sorted(told.collect()) == sorted(same.collect())
    assert S.content_map(told, cut) == S.content_map(told)
    check(make_docs, rows)
