"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import brute
import pytest
from compare import connect, spark_rows, sql_rows

from trifold.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """word, form, root, n, n_near, form_n."""
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f if (f := best.get(w)) and n[f] >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(8)
    base = ["".join(rng.choice("abénñ") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    chain = ["kettles", "kettlesa", "kettlesab", "kettlesabc"]
    rows = [*corpus, (700, " ".join(chain[k] for k in range(4) for _ in range(2 * 10**k))), (701, "Straßenbahnen STRASSENBAHN aaaaaaaa aaaaaaa aaaaaaaaa " * 3), (702, "z" * 3_000 + " " + "z" * 3_000)]
    for d in range(800, 860):
        words = []
        for _ in range(60):
            w = list(rng.choice(base))
            if rng.random() < 0.4:
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é", "x"])
            words.append("".join(w))
        rows.append((d, rng.choice([" ", "\n", "-"]).join(words)))
    return [*rows, rows[-1], (None, rows[-2][1])]


def test_whole(spark, frame, texts, tmp_path):
    frame(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op11_spelling(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]
    want = plain(texts)
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] for r in want) > 500
    assert sorted(map(tuple, got.collect()), key=repr) == want
    names, rows = spark_rows(got)
    assert (names, rows) == sql_rows(connect(str(tmp_path)), spelling.ORACLE["op11_spelling"])


def test_keys_meet(spark):
    """Words of few letters, where bigrams repeat and ranks tie: no near pair is lost, whatever its edit's place."""
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(300)} | {"a" * k for k in range(7, 14)} | {"xaaaaaaa", "aaaaaaax", "aaaxaaaa"}
    got = spelling.near(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(min(a, b), max(a, b)) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_pivots_are_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        cost = [rng.randint(1, 9) for _ in range(rng.randint(6, 12))]
        places, wide = spelling.prefix_of(cost)
        assert len(places) == 3 and set(places) <= set(wide) and len(wide) <= 7
        chosen = spelling.pivots(cost, places)
        assert chosen[1] - chosen[0] >= 2 and set(chosen) <= set(places)
        assert sum(cost[i] for i in chosen) == min(cost[i] + cost[j] for i, j in combinations(sorted(places), 2) if j - i >= 2)
    assert spelling.pivots([1, 1, 1], [0, 1]) is None


def test_no_words(spark, frame):
    assert spelling.groups(frame([])).collect() == []
    assert spelling.groups(frame([(1, None), (2, ""), (3, "short words only")])).collect() == []
