import numpy as np
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, `n_words` string, sid string, `norm` int"


@pytest.fixture(scope="session")
def corpus():
    """Odd rows: nulls everywhere, empty and very long texts, ties, copies."""
    rng = np.random.default_rng(0)
    syllables = ["ka", "lo", "mi", "ter", "un", "bra", "se", "vo"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[60] = "Changed"
    texts = [None, "", " \n\t", "7 8 9", "one", "One!", base, base, " ".join(near), " ".join(word() for _ in range(40)), "x" * 300_000, " ".join(word() for _ in range(9000)), "Über straße 漢字 \U0001f600 ok", "| a | b | a | b | a | b | a | b"]
    rows = [(i, t, "en" if i % 2 else None, None, None, "own", "own", "own", i) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id here at all", "de", "s", 1, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
