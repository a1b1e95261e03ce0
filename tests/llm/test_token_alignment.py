"""Alignment against a plain version over whole texts; odd texts; SparkFiles round trip."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS
from wardline.llm.token_alignment import alignment, default_tokenizers


@pytest.fixture(scope="module")
def plain_tokens():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(x): x for x in printable}
    spelled |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        """[(ids, token bytes)] of A and B, of whole texts."""
        of_a = a.encode(" " + text, add_special_tokens=False)
        of_b = b.encode(text)
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in of_b for p in [b.id_to_piece(i)]]
        return (of_a.ids, [bytes(spelled[c] for c in t) for t in of_a.tokens]), (of_b, bytes_b)

    return tokens


def brute(rows, tokens):
    groups, holds = [], Counter()
    for _, text in rows:
        found = []
        if text:
            (ids_a, by_a), (ids_b, by_b) = tokens(text)
            if b"".join(by_a) == b"".join(by_b) == (" " + text).encode():
                left, right, size_a, size_b, i, j = [], [], 0, 0, 0, 0
                while i < len(ids_a) or j < len(ids_b):
                    if size_a <= size_b and i < len(ids_a):
                        size_a, i = size_a + len(by_a[i]), i + 1
                        left.append(ids_a[i - 1])
                    else:
                        size_b, j = size_b + len(by_b[j]), j + 1
                        right.append(ids_b[j - 1])
                    if size_a == size_b:
                        found.append((left, right))
                        left, right = [], []
        groups.append(found)
        holds.update({(x, y) for xs, ys in found for x in xs for y in ys})
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), found in zip(rows, groups):
        links = [(x, y) for xs, ys in found for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in found)
        out.append((doc_id, sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found),
                    len(links), sum(holds[p] == best[p[0]] for p in links),
                    sum(holds[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if found else ""))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def check(spark, make_docs, tokens, rows):
    got = [tuple(r) for r in alignment(make_docs(rows), default_tokenizers(spark)).collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in rows], tokens), key=key)
    return got


def test_equals_whole_texts(spark, make_docs, words, plain_tokens):
    rows = [(i, words(40 + i, i % 30)) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate([
        "It's 12,345.67 EUR, isn't it?  Two  spaces\n\n and\ttabs \n x", "你好世界 été naïve \U0001f600\U0001f680",
        "def f(x):\n    return x == 'a'\n\n\n", " leading", "trailing ", "   ", "\n", "a",
        "<|endoftext|> <s> </s> <unk> <0x41> [INST]", "==========----------" * 30, "aaaaaaaa" * 200,
        "مرحبا світ ẞ ﬁ Å é", "x y z　w​v"])]
    got = check(spark, make_docs, plain_tokens, rows)
    assert [r for r in got if r[1] == 0] == []


def test_odd_rows(spark, make_docs, plain_tokens):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [
        (None, "no id"), (3, "twice"), (3, "twice"), (50, "a▁b"), (51, "▁")]
    got = {r[0]: r for r in check(spark, make_docs, plain_tokens, rows)}
    assert got[0][1:] == got[1][1:] == got[50][1:] == got[51][1:] == (0, 0, 0, 0, 0, 0, "")


def test_empty_table(spark, make_docs):
    assert alignment(make_docs([]).limit(0), default_tokenizers(spark)).collect() == []


def test_very_long_text(spark, make_docs, words):
    """Beyond a 4 MB slice: n copies of a line give n times its tokens, groups and links."""
    line = words(2000, 1) + " \n"
    rows = [(1, line), (2, line * 400), (3, words(3, 2))]
    got = {r.doc_id: r for r in alignment(make_docs(rows), default_tokenizers(spark)).collect()}
    assert len(rows[1][1]) > 4 << 20
    for c in ("n_a", "n_b", "n_groups", "n_links"):  # the line's last space goes to the next line
        assert abs(got[2][c] - 400 * got[1][c]) <= 800
    assert got[2].n_best > 0.9 * 400 * got[1].n_best


def test_pieces_equal_whole_texts(words):
    from wardline.llm.textblocks import text_blocks
    from wardline.llm.token_alignment import Encoder
    import pyarrow as pa

    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    cut, whole = Encoder(*paths), Encoder(*paths)
    assert cut.splits
    whole.splits = False
    texts = pa.array([" " + words(100, i) + "  x \n y  " for i in range(5)])
    for block in text_blocks(texts):
        assert [t.to_pylist() for t in cut.encode(block)] == [t.to_pylist() for t in whole.encode(block)]
