"""Fixtures of the corpus tests: a small corpus with every awkward case."""

from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + (str(draw.randrange(40)) if draw.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """doc_id, text, source, lang, and columns whose names operators use themselves."""
    draw = random.Random(1)
    rows = [(i, prose(draw, draw.randrange(1, 120) if i else 90), f"s{i % 4}" if i % 9 else None) for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, " \n\t", "s2"), (103, "one", "s2"), (None, "no id here " * 9, "s3")]
    rows += [(104, prose(draw, 12_000), "s0"), (105, "9" * 30_000, "s0"), (106, "long" * 20_000, "s0"), (107, "😀 é " * 50, None)]
    rows += [(i, rows[0][1], "s0") for i in range(200, 230)] + [rows[1]] * 3  # copies, and repeated rows
    clash = "doc_id long, text string, source string"
    return spark.createDataFrame([(*r, "x", 1, 2.0, [1]) for r in rows], f"{clash}, row string, node int, score double, key array<int>")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
