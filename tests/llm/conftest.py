import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "batch int, part int, key string, h1 long, round int, rep long, n long, kept boolean, rank int, bucket int, print string, at string"


def copies(seed: int = 3) -> list[tuple[int, str]]:
    """Texts that share passages, lines and near copies, with a passage in a third of all."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    base = " ".join(rng.choice(words) for _ in range(80))
    out = []
    for d in range(60):
        own = " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))
        if d % 3 == 0:
            own = f"{own[:40]}\n{passage}\n{own}"
        if d % 7 == 0:
            edited = base.split()
            for _ in range(d % 5):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            own = " ".join(edited)
        if d % 4 == 0:
            own += "\nA shared Line \t\n" * (d % 3)
        out.append((d, own))
    return out


@pytest.fixture(scope="session")
def shared_texts(spark):
    rows = copies()
    return dict(rows), spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names of the operators' own."""
    long = "all work and no play makes a dull page " * 4000
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\r\n\v\f ", None), (4, "the same row twice " * 20, "en"), (4, "the same row twice " * 20, "en"),
        (5, "one id two texts", "en"), (5, "and this is the other text of it", "en"), (None, "no id but text " * 20, "en"), (None, None, None),
        (6, long, "en"), (7, long, "fr"), (8, "12345 67890 !!!", None), (9, "\x00nul and é ß 漢字 😀 words", "de"), (10, "x" * 100_000, "en"), (11, "é", "fr"),
    ]
    full = [(d, t, lang, None, None, 1, 2, "k", 3, 4, 5, 6, True, 7, 8, "p", "a") for d, t, lang in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASHING}")
