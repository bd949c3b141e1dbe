from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho "
         "sigma tau upsilon phi chi psi omega").split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty, short and very long texts, copies, repeated rows, ties,
    and extra columns whose names the operators use themselves."""
    long = prose(99, 30_000)
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    rows = [
        (1, base, "en", "a", 1), (2, near, "en", "a", 2), (3, base, None, None, None),
        (4, None, "en", "b", 4), (5, "", "en", "b", 5), (6, "one two", "fr", None, 6),
        (7, long, "en", "a", 7), (8, long + " end", "en", "c", 8), (None, prose(3, 40), "en", "c", 9),
        (None, None, None, None, None), (9, prose(4, 60), "en", "d", 1), (9, prose(4, 60), "en", "d", 1),
        (10, " \t\n ", "en", "", 3), (11, "Ünï © “x” 漢字 " + prose(5, 30), "en", "é", 3),
    ]
    rows += [(100 + i, prose(100 + i, 20 + i), "en", "abc"[i % 3], i) for i in range(30)]
    return spark.createDataFrame([(*row, "x", "y") for row in rows], DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
