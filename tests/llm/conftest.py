"""Fixtures of the corpus tests: texts with every awkward case, and plain brute-force forms of the contracts."""

import random

import pytest

#: Names that work columns might have; they must come through or go without a clash.
EXTRA = "d long, t string, row string, key string, kept string, score double, h long, `a b` string"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared lines and passages, nulls, empty and long texts, ties."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "ñu", "ti", "ing", "sh"]) for _ in range(r.randint(1, 3)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    shared_line, passage = "  This Line is shared by many DOCUMENTS  ", " ".join(word() for _ in range(60))
    base = [sentence(r.randint(40, 120)) for _ in range(12)]
    out = [(i, x) for i, x in enumerate(base)]
    out += [(100 + i, x) for i, x in enumerate(base[:4])]  # copies
    for i, x in enumerate(base[4:8]):
        w = x.split()
        w[len(w) // 2] = "changed"
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, f"{sentence(5)}\n{shared_line}\n{sentence(6)}\n\n{shared_line.upper()}") for i in range(5)]
    out += [(400 + i, f"{sentence(9)} {passage} {sentence(7)}") for i in range(4)]
    out += [(500, None), (501, ""), (502, "one"), (503, "One two"), (504, "\n\n"), (505, "x " * 30_000), (506, "é\x1c  a\x85b"), (507, "a b c d e"), (508, "A B C D E")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts in several partitions, with further columns of clashing names."""
    rows = [(i, t, i, "x", "r", "k", "q", 1.0, 2, "s") for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
