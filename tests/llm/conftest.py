from __future__ import annotations

import random

import pytest
from odd import SCHEMA, words

@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, long, equal, nearly equal and repeated texts; null ids and sources; columns whose names clash."""
    rng = random.Random(5)
    base = words(rng, 80)
    near = base.split()
    near[40] = "changed"
    far = base.split()[:40] + words(rng, 60).split()
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), " ".join(far), words(rng, 9000), "x" * 70_000, "ÄÖÜ ñ é 日本語 <|endoftext|> it's a"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1.5, 7, 3, "t") for i, t in enumerate(texts)]
    rows += [(5, base, "en", "s2", len(base), 0.0, 0, 0, None), (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[8], rows[8]]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
