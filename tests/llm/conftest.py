import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empty and long texts, copies, ties and repeated rows."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].upper(), "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, base[20] + " " + words(rng, 1), "en", None, 0) for i in range(8)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n", "en", "s1", 3), (303, "ÉCOLE Straße", "fr", "s2", 12), (304, "éCOLE Straße", "fr", "s2", 12)]
    rows += [(305, words(rng, 20_000), "en", "s0", 0), (306, "\n".join(base[:10]), "en", "s2", 0), (0, base[0], "en", "s0", 1), (None, base[1], "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    return rows, df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
