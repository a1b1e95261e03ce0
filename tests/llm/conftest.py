from __future__ import annotations

import random

import pytest

from wardline.llm.deploy import ship_package

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # columns whose names the operators use inside
          "id long, sig long, score double, n long, label string, tokens string, keep boolean, "
          "text_key long, block int, shard int, __id long, comp long, kept string, start long")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship_package(spark)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with extra columns."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")),
                 len(r[1] or ""), 1, 2, 0.5, 3, "x", "y", True, 4, 5, 6, 7, 8, "z", 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def words():
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
             for _ in range(3000)]

    def text(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(stock) for _ in range(n))

    return text


ODD_TEXTS = [None, "", " ", "\n\n", "one", "été 你好 \U0001f600", "a\x00b \x1c c d",
             "tab\tsep\x0bx\x0cy\r\nz"]
