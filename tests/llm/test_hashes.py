"""Strings that collide under polynomial hashes modulo 2**64 stay apart everywhere."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardline.llm.jaccard_join import jaccard_components
from wardline.llm.line_crf import LineBlock
from wardline.llm.line_dedup import Lines
from wardline.llm.textblocks import LONG_SPAN, TextBlock, text_blocks
from wardline.llm.token_file import default_tokenizer, encode_documents


def thue_morse(n: int, letters: str) -> str:
    """The Thue-Morse word of n letters."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (1024, 2048)]


def test_polynomial_hashes_collide_and_these_do_not():
    for a, b in PAIRS:
        (block,) = text_blocks(pa.array([a, b]))
        starts, ends = block.offsets[:-1], block.offsets[1:]
        plain = block.span_hash(block.prefix_hash(), starts, ends)
        assert plain[0] == plain[1]
        assert len(set(block.hashes(starts, ends).tolist())) == 2


def test_hashes_depend_on_the_bytes_alone():
    rng = random.Random(3)
    spans = [bytes(rng.choices(b"ab\x00\xff", k=k)) for k in [*range(70), 1023, 1024, 1025, 4000] for _ in range(3)]
    spans += [b"a" * k for k in range(40)] + [b"a" * k + b"\x00" for k in range(40)]
    at = rng.sample(range(len(spans)), len(spans))

    def hashed(order):
        data = b"".join(spans[i] for i in order)
        ends = np.cumsum([len(spans[i]) for i in order])
        block = TextBlock(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        return dict(zip(order, block.hashes(ends - [len(spans[i]) for i in order], ends).tolist()))

    first, second = hashed(range(len(spans))), hashed(at)
    assert first == second
    assert len(set(first.values())) == len(set(spans))
    assert LONG_SPAN < 4000


@pytest.mark.parametrize("a,b", PAIRS)
def test_jaccard_join_keeps_them_apart(make_docs, a, b):
    got = {r.doc_id: r.component_id for r in jaccard_components(make_docs([(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_token_file_encodes_both(make_docs):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    rows = [(i, "abababab" + t) for i, t in enumerate(x for pair in PAIRS for x in pair)]
    got = {r.doc_id: r.ids_crc32 for r in encode_documents(make_docs(rows), default_tokenizer()).collect()}
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_lines_are_not_equal():
    for a, b in PAIRS:
        (block,) = text_blocks(pa.array([f"{a}\n{b}\n{a}"]))
        assert LineBlock(block).n_dup_lines.tolist() == [1]
        assert len(set(Lines(block).id.tolist())) == 2


def test_suffix_dedup_removes_true_repeats_alone(make_docs):
    from wardline.llm.suffix_dedup import dedup_text

    (a, b), _ = PAIRS
    rows = [(1, "x " + a), (2, "y " + b), (3, "z " + a)]
    got = {r.doc_id: bytes(r.kept) for r in dedup_text(make_docs(rows)).collect()}
    seen: set[bytes] = set()
    for i, text in rows:
        data = text.encode()
        keep = np.ones(len(data), bool)
        for at in range(len(data) - 49):
            if data[at:at + 50] in seen:
                keep[at:at + 50] = False
        seen |= {data[at:at + 50] for at in range(len(data) - 49)}
        assert got[i] == np.frombuffer(data, np.uint8)[keep].tobytes()
