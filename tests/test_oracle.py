"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import pytest
from compare import connect, spark_rows, sql_rows

from trifold.plans import registry

registry.load()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf, duck, name):
    names, rows = spark_rows(registry.QUERIES[name](spark, sf))
    want_names, want = sql_rows(duck, registry.ORACLE[name])
    assert names == want_names
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    """Queries without SQL give rows, and no number in them is unknown."""
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows
    assert not any(isinstance(x, float) and x != x for r in rows for x in r)


def test_no_corpus_imports():
    """Nothing outside the corpus subpackage imports it."""
    from pathlib import Path

    root = Path(registry.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "trifold.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
