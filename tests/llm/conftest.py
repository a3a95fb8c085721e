from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Columns whose names operators use themselves.
CLASHING = ["score", "kept", "print", "bucket", "n_words", "digest", "length", "key", "spans", "edits", "lang"]


def word(rng, n=400):
    return f"w{rng.randrange(n)}é" if rng.random() < 0.1 else f"w{rng.randrange(n)}"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random texts, copies, near copies, shared passages, empty and null ones, one long."""
    rng = random.Random(11)
    passage = " ".join(word(rng) for _ in range(30))
    texts = [" ".join(word(rng) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    for k in range(0, 60, 4):
        w = texts[k].split()
        at = rng.randint(0, len(w))
        texts[k] = " ".join([*w[:at], passage, *w[at:]])
    texts += [texts[3], texts[3].replace(" ", "\n"), texts[4] + "  ", "\t" + texts[5].upper(), texts[6] + " more", texts[0] + " tail"]
    texts += ["", None, " \n ", "x", "one two", "x", passage, passage, " ".join(word(rng, 5) for _ in range(6000)), "a b " * 40]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(d, t, "s", 1, *["en"] * len(CLASHING)) for d, t in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def plain():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
