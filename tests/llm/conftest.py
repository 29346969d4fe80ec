import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, shard int, th long, cls long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]) with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None, -1, -1, -1, -1) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded prose: ``prose(seed, n)`` is n words, from a small vocabulary."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make


#: Texts that every operator must take: null, empty, blank, short, repeated, control characters, several scripts, long.
ODD_TEXTS = [None, "", " \t\n", "one", "one", "two words", "\x0b\x0c", "Ünïcode – 中文 \U0001f600 x\u00a0y", "A b C d E f", "a B c D e F", "same " * 300, "\n".join(["a line that comes again and again"] * 60), "x" * 50_000]
