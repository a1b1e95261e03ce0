import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS
from wardline.llm import token_file as T
from wardline.llm.textblocks import text_blocks

ODD = [*ODD_TEXTS, "<|endoftext|>.", "a<|startoftext|>b <|ENDOFTEXT|>", "it's. It'S 'S, don't,, x..",
       "ß. ΑΣ. é, Ａ.", "9. 9, a.b,c. .,", "a.\nb,\nc"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


@pytest.mark.parametrize("by_piece", [True, False])
def test_pieces_equal_whole_texts(plain, by_piece):
    own = T.PieceEncoder(T.default_tokenizer())
    assert own.by_piece
    own.by_piece = by_piece
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aBé'.,! \n\t9&<|>") for _ in range(60)) for _ in range(300)]
    for block in text_blocks(pa.array(texts)):
        ids, counts = own.encode(block)
        ends = np.cumsum(counts)
        for i in range(len(block)):
            assert ids[ends[i] - counts[i]:ends[i]].tolist() == plain(texts[block.first + i])


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = T.pack(ranks)
        assert len(control) == -(-n // 4)
        assert T.unpack(control, data, n).tolist() == ranks.tolist()


def test_file_round_trip(make_docs, plain, words, spark, tmp_path):
    rows = [(i * 7 % 50, words(30, i)) for i in range(50)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(3, "twice"), (3, "twice")]
    got = T.encode_documents(make_docs(rows), T.default_tokenizer()).orderBy("start").collect()
    start = 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or ""))):
        ids = plain(text)
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)


def test_ranks_follow_frequency(make_docs, plain):
    docs = make_docs([(1, "b b b b a"), (2, "b c c")])
    ranks = T.id_ranks(docs, T.default_tokenizer())
    b, c, a = (plain(x)[0] for x in "bca")
    assert ranks[b] == 0 and sorted(ranks.tolist()) == list(range(len(ranks)))
    assert ranks[b] < ranks[T.END_ID] and ranks[c] < ranks[a]


def test_null_ids_and_empty_table(make_docs):
    out = T.encode_documents(make_docs([(5, "x"), (None, "y")]), T.default_tokenizer())
    assert [r.doc_id for r in out.orderBy("start").collect()] == [None, 5]
    assert T.encode_documents(make_docs([]), T.default_tokenizer()).collect() == []
