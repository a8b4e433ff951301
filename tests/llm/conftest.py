"""Documents with every awkward case at once."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, key long, v long, part int"


@pytest.fixture(scope="session")
def words():
    def make(seed: int, n: int) -> list[str]:
        out, x = [], seed
        for _ in range(n):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            out.append("w" + format(x >> 40, "x"))
        return out

    return make


@pytest.fixture(scope="session")
def texts(words):
    base, other, passage = words(1, 120), words(2, 150), words(3, 70)
    near = base.copy()
    near[60] = "changed"
    far = [w if i % 6 else f"x{i}" for i, w in enumerate(base)]
    return [
        (0, " ".join(base)),
        (1, " ".join(near)),
        (2, " ".join(base).upper()),
        (3, " ".join(far)),
        (4, " ".join(other[:40] + passage + other[40:80])),
        (5, " ".join(other[80:110] + passage + other[110:])),
        (6, ""),
        (7, None),
        (8, " \t\n "),
        (9, "one two three"),
        (10, "One\ttwo\nTHREE"),
        (11, " ".join(base)),
        (11, " ".join(base)),
        (12, " ".join(words(9, 6000) + passage)),
        (13, "Ünï   çödé #*$ | <x> <|endoftext|> 'S 12²"),
        (14, "\n".join(["same line here now"] * 30 + [" ".join(words(5, 60))])),
        (None, " ".join(base)),
        (None, "alone"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", 0, "b", k, k, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
