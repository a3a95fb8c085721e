"""Exact, near and substring deduplication against plain versions."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trifold.llm import exact, nearcopies, simhash, substrings
from trifold.llm.common import numbered, stored
from trifold.llm.fmindex import FMIndex


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_classes(frame, corpus):
    out = exact.classes(frame(corpus))
    want = brute.op3(corpus)
    got = by_id(out, "keep_id", "group_size", "kept")
    assert got == {d: (*want[d], want[d][0] == d) for d, _ in corpus}


def test_exact_nulls_repeats_and_empty(frame):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a  b"), (None, None), (5, "ab")]
    got = sorted(exact.classes(frame(rows)).select("doc_id", "keep_id", "group_size", "kept").collect(), key=repr)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(1, None, 5 - 1, False), (None, None, 4, True), (5, None, 4, False), (2, 2, 3, True), (3, 2, 3, False), (None, 2, 3, False)} and len(got) == 7
    assert exact.classes(frame([])).count() == 0
    kept = exact.drop_copies(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == [(2, None), (None, "a  b")]


def test_exact_decides_by_row(spark, frame):
    """Of repeated rows one stays, and rows of one doc_id go each by its own text, read from files or not."""
    rows = [(0, "y"), (1, "x"), (1, "y"), (1, "x"), (None, "p"), (None, "q"), (None, "p"), (5, None), (5, "")]
    want = [(0, "y"), (1, "x"), (5, None), (None, "p"), (None, "q")]
    for docs, as_read in ((frame(rows), False), (stored(frame(rows)), True), (stored(frame(rows)).where("doc_id IS NULL OR doc_id >= 0"), True)):
        got = exact.drop_copies(docs, as_read=as_read).select("doc_id", "text").collect()
        assert sorted(((r["doc_id"], r["text"] or None) for r in got), key=repr) == sorted(want, key=repr)
    flags = sorted(((r["doc_id"], r["keep_id"], r["kept"]) for r in exact.classes(frame(rows)).collect()), key=repr)
    assert flags == sorted([(0, 0, True), (1, 1, True), (1, 0, False), (1, 1, False), (None, None, True), (None, None, True), (None, None, False), (5, 5, True), (5, 5, False)], key=repr)


def test_many_dropped_rows_take_a_join(frame, monkeypatch):
    monkeypatch.setattr("trifold.llm.common.FEW_ROWS", 1)
    rows = [(k, f"t{k % 7}") for k in range(40)]
    assert sorted(r["doc_id"] for r in exact.drop_copies(frame(rows)).collect()) == list(range(7))


def test_rows_are_numbered(spark, frame):
    clash = stored(frame([(k, "t") for k in range(9)]).withColumn("_metadata", F.lit("mine")))
    for docs in (numbered(frame([(1, "a")] * 9)), numbered(clash, as_read=True)):
        assert docs.select(docs.columns[-1]).distinct().count() == 9


def test_index_admits_only_new(spark, frame, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=3)
    first = exact.drop_copies(frame([(1, "a b"), (2, "ab"), (3, "c")]), index)
    assert sorted(r["doc_id"] for r in first.collect()) == [1, 3]
    second = exact.drop_copies(frame([(4, "a\nb"), (5, "d"), (6, "d "), (7, None)]), index)
    assert sorted(r["doc_id"] for r in second.collect()) == [6, 7]
    assert exact.drop_copies(frame([(8, "D"), (9, "c")]), index).count() == 1
    assert index.read().count() == 5
    index.drop()


def test_index_outlives_its_table(spark, frame, tmp_path):
    """Files at a path are taken up again by a session whose catalog doesn't know the table, whatever number of buckets it asks for."""
    path = str(tmp_path / "index")
    index = exact.DigestIndex(spark, path, buckets=3)
    texts = [(k, f"text {k}") for k in range(200)]
    exact.drop_copies(frame([(1, "a b"), (2, "c"), *texts]), index).count()
    index.close()
    for asked in (3, 8, 16):
        again = exact.DigestIndex(spark, path, buckets=asked)
        assert again.buckets == 3
        assert exact.drop_copies(frame([(7, "ab"), *texts]), again).count() == 0
    assert [r["doc_id"] for r in exact.drop_copies(frame([(7, "ab"), (8, "d")]), again).collect()] == [8]
    assert again.read().count() == 203
    again.drop()
    lost = exact.DigestIndex(spark, path, buckets=4)
    assert lost.buckets == 4 and lost.read().count() == 0 and exact.drop_copies(frame([(7, "ab")]), lost).count() == 1
    lost.drop()


def test_batch_that_runs_again(spark, frame, tmp_path, monkeypatch):
    """A batch that was stopped before or after its digests were written gives the rows of one run, before and after other batches."""
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    one, two = frame([(1, "a b"), (2, "ab"), (3, "c")]), frame([(4, "c"), (5, "d"), (5, "e")])
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    put = exact.DigestIndex.put
    for stop_after in (False, True):

        def stopped(self, groups, batch, late=stop_after):
            if late:
                put(self, groups, batch)
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(exact.DigestIndex, "put", stopped)
            with pytest.raises(OSError, match="lost"):
                exact.drop_copies(one, index, batch="one")
    assert ids(exact.drop_copies(one, index, batch="one")) == [1, 3]
    assert ids(exact.drop_copies(two, index, batch="two")) == [5, 5]
    for _ in range(2):
        assert ids(exact.drop_copies(one, index, batch="one")) == [1, 3]
        assert by_id(exact.classes(two, index, batch="two").where("digest = digest"), "keep_id")[4] == (3,)
    assert index.read().count() == index.read().select("digest").distinct().count() == 4
    index.drop()


def test_copies_of_an_index_go(spark, frame):
    index = exact.DigestIndex.fresh(spark, 9_000_000)
    assert index.buckets == exact.BUCKETS and exact.DigestIndex.fresh(spark, exact.ROWS_A_BUCKET * 100 + 1).buckets == 101
    before = {t.name for t in spark.catalog.listTables()}
    kept = exact.drop_copies(frame([(1, "a b"), (2, "ab"), (None, "c"), (4, "c")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4] and {t.name for t in spark.catalog.listTables()} == before
    exact.drop_copies(frame([(1, "a b")]), index).count()
    assert [r["doc_id"] for r in exact.drop_copies(frame([(7, "ab"), (8, "d")]), index).collect()] == [8]
    index.drop()


def test_two_batches_of_classes(spark, frame):
    index = exact.DigestIndex.fresh(spark, 1)
    first = exact.classes(frame([(1, "a b"), (2, "ab"), (3, "c")]), index)
    assert by_id(first, "keep_id", "group_size", "kept") == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}
    second = exact.classes(frame([(1, "a b"), (4, "ab"), (5, "d"), (6, "d ")]), index)
    rows = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in second.collect())
    assert rows == [(1, 1, 2, False), (4, 1, 2, False), (5, 6, 2, False), (6, 6, 2, True)]
    assert index.read().count() == index.read().select("digest").distinct().count() == 3
    assert [r["doc_id"] for r in exact.drop_copies(frame([(7, "d"), (8, "e")]), index).collect()] == [8]
    index.drop()


def test_one_admission_anti_joins(spark, frame, monkeypatch):
    calls = []
    admit = exact.DigestIndex.admit
    monkeypatch.setattr(exact.DigestIndex, "admit", lambda self, groups, batch: calls.append(1) or admit(self, groups, batch))
    exact.classes(frame([(1, "a")])).count()
    exact.drop_copies(frame([(1, "a")])).count()
    assert len(calls) == 2


def test_hot_groups_stay_whole(spark, frame, monkeypatch):
    monkeypatch.setattr("trifold.llm.common.HOT", 3)
    rows = [(k, "same" if k % 2 else f"t{k}") for k in range(40)]
    got = by_id(exact.classes(frame(rows)), "keep_id", "group_size")
    assert got == {k: (1, 20) if k % 2 else (k, 1) for k in range(40)}


def test_simhash_classes(frame, corpus):
    prints = {d: brute.simhash(t) for d, t in corpus}
    want = brute.classes(prints)
    rows = simhash.classes(frame(corpus)).collect()
    assert {r["doc_id"]: r["print"] & (1 << 64) - 1 for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def test_links_find_every_pair(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints):
        q = p
        for _ in range(rng.randint(1, 4)):
            q ^= 1 << rng.randrange(64)
            prints.add(q)
    prints |= {0, (1 << 64) - 1, 1 << 63, 1}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    root = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(simhash.links(df)).collect()}
    got, want = {}, {}
    for p, c in brute.classes({p: p for p in prints}).items():
        want.setdefault(c, set()).add(p)
    for p in prints:
        got.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_runs_are_cut_exactly(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (12, 9), dtype=np.uint64))]).ravel())
    monkeypatch.setattr(simhash, "BLOCK", 16)

    def parts(links):
        label = {int(p): int(p) for p in prints}
        for _ in range(len(prints)):
            for a, b in links.tolist():
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(simhash.local_links(prints)) == brute.classes({int(p): int(p) for p in prints})


def test_simhash_empty_and_repeated(frame):
    assert simhash.classes(frame([])).count() == 0
    got = simhash.classes(frame([(3, ""), (1, None), (1, None), (7, "a")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (3, 1), (7, 7)]


@pytest.mark.parametrize("few", [10**6, 3, 0])
def test_star_contraction(spark, monkeypatch, few):
    """In one task or by turns, with a node that most links have, or not."""
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    edges = [(k, k + 1) for k in range(1, 20)] + [(200, 201), (202, 201)] + [(300, k) for k in range(301, 330)] + [(329, 299), (5, 5)]
    out = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 1 for k in range(2, 21)}, 201: 200, 202: 200, **{k: 299 for k in range(300, 330)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near_corpus(seed):
    rng = random.Random(seed)
    docs = []
    for k in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = "edited"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_near_copies(frame):
    rows = [*_near_corpus(3), (700, None), (701, ""), (702, "one two"), (703, "One  TWO"), (704, "two one"), (None, "one two"), (None, "lone text")]
    want = [rows[i][0] for i in brute.near(rows)]
    kept = nearcopies.drop_near_copies(frame(rows))
    assert kept.columns == frame(rows).columns and len(want) < len(rows) - 10
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_by_row(frame):
    text = " ".join(f"v{k}" for k in range(50))
    rows = [(4, text), (4, text), (4, "other"), (None, "x"), (None, "x"), (9, text.upper()), (1, text + " more")]
    got = [(r["doc_id"], r["text"]) for r in nearcopies.drop_near_copies(frame(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, text + " more"), (4, "other"), (None, "x")], key=repr)
    assert nearcopies.drop_near_copies(frame([])).count() == 0


def test_long_text_has_a_print():
    text = " ".join(f"v{k}" for k in range(100_000))
    sets = nearcopies.shingle_sets(pa.array([text, "a b", ""]))
    assert [len(s) for s in sets] == [99_996, 1, 0]
    bits, loose = nearcopies.fingerprint(sets[0])
    count = sum(np.unpackbits(nearcopies.mix(sets[0][a : a + 1000, None] ^ nearcopies._SALT).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(sets[0]), 1000))
    assert bits == np.packbits(2 * count > len(sets[0]), bitorder="little").tobytes()
    assert np.unpackbits(np.frombuffer(loose, np.uint8)).sum() == nearcopies.SEGMENTS * nearcopies.LOOSE


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (5, nearcopies.LONGS), dtype=np.uint64)
    prints = np.repeat(base, 30, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (150, nearcopies.LONGS), dtype=np.uint64)) * (rng.random((150, nearcopies.LONGS)) < 0.5)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 9
    links = nearcopies.forest(prints, (4, 9))
    assert all(near[u, v] for u, v in links)

    def parts(pairs):
        label = list(range(len(prints)))
        for u, v in pairs:
            old, new = max(label[u], label[v]), min(label[u], label[v])
            label = [new if x == old else x for x in label]
        return label

    assert parts(links) == parts(np.argwhere(near).tolist())


def test_substrings(frame, corpus):
    out = substrings.remove_repeated(frame(corpus)).withColumn("h", F.sha2("kept", 256))
    assert by_id(out, "n_words", "n_removed", "h") == brute.op1(corpus)


def test_substrings_hot_runs(frame, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SYMBOLS", 200)
    out = substrings.remove_repeated(frame(corpus)).withColumn("h", F.sha2("kept", 256))
    assert by_id(out, "n_words", "n_removed", "h") == brute.op1(corpus)


def test_substrings_few_partitions(spark, frame, corpus, monkeypatch):
    """Several buckets in a partition, and hashes sent in small parts, give the same rows without further exchanges."""
    monkeypatch.setattr(substrings, "partitions", lambda spark: 13)
    monkeypatch.setattr(substrings, "MOST_PARTS", 3)
    monkeypatch.setattr(substrings, "SENT_KEYS", 50)
    out = substrings.remove_repeated(frame(corpus)).withColumn("h", F.sha2("kept", 256))
    assert by_id(out, "n_words", "n_removed", "h") == brute.op1(corpus)
    plan = substrings.remove_repeated(frame(corpus))._jdf.queryExecution().executedPlan().toString()
    # The texts' exchange stands in the plan twice, and is run once.
    assert (plan.count("shufflepartitionidpassthrough"), plan.count("Exchange hashpartitioning")) == (5, 1), plan


def test_substrings_passage_in_every_bucket(frame, monkeypatch):
    """A passage of all documents, over many buckets and small Arrow batches: each bucket gives one row for a window, none with a list."""
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(substrings, "SYMBOLS", 50)
    monkeypatch.setattr(substrings, "ANSWERS", 100)
    monkeypatch.setattr(substrings, "partitions", lambda spark: 13)
    passage = " ".join(f"p{i}" for i in range(40))
    other = " ".join(f"q{i}" for i in range(16))
    rows = [(d, f"u{d} {passage} v{d} " + (other if d % 3 == 0 else "") + (f" {passage}" if d % 50 == 0 else "")) for d in range(300)]
    rows += [(7, f"z {other} {passage}"), (None, passage), (None, f"{passage} y"), ((1 << 63) - 1, f"w {passage}"), (299, None)]
    docs = frame(rows)
    sizes = docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeated(docs).collect()), key=repr)
    finally:
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sizes)
    assert got == sorted(brute.substrings_rows(rows, substrings.WINDOW), key=repr)


def test_substrings_nulls_repeats_and_empty(frame):
    text = " ".join(f"q{k}" for k in range(20))
    rows = [(2, text), (2, text), (None, text), (9, None)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.remove_repeated(frame(rows)).collect()), key=repr)
    assert got == [(2, 0), (2, 0), (9, 0), (None, 20)]
    assert substrings.remove_repeated(frame([])).count() == 0


def test_substrings_texts_under_one_id(frame, monkeypatch):
    """Intervals are those of a text, not of all texts under its doc_id."""
    shared, q = (" ".join(f"{c}{k}" for k in range(20)) for c in "sq")
    tail = " ".join(f"t{k}" for k in range(30))
    for d in (None, 7):
        rows = [(1, shared), (d, f"{tail} {shared}"), (d, q), (d, f"{shared} {tail}"), (d, "short"), (d, shared), (d, shared), (d, None), (8, q)]
        for parts in (1, 4):  # with one part all texts share a bucket
            df = frame(rows)
            monkeypatch.setattr(substrings, "partitions", lambda spark, n=parts: n)
            got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeated(df).collect()), key=repr)
            want = [(1, 20, 0, shared), (d, 50, 20, tail), (d, 20, 20 if d is None else 0, "" if d is None else q), (d, 50, 20, tail), (d, 1, 0, "short"), (d, 20, 20, ""), (d, 20, 20, ""), (d, 0, 0, ""), (8, 20, 0 if d is None else 20, q if d is None else "")]
            assert got == sorted(want, key=repr)


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(8)
    text = np.concatenate([np.append(rng.integers(1, 5, 40), 0) for _ in range(6)])
    index = FMIndex(text, 5, 7)
    query = rng.integers(1, 5, 60)
    query[17] = -1  # a symbol that the index doesn't know
    first = np.array([0, 25, 25, 60])
    length, where = index.matching_statistics(query, first)
    flat = text.tolist()
    for i in range(60):
        end = first[np.searchsorted(first, i, "right")]
        best = 0
        while best < min(7, end - i) and any(flat[s : s + best + 1] == query[i : i + best + 1].tolist() for s in range(len(flat))):
            best += 1
        assert length[i] == best
        at = index.suffixes[where[i]]
        assert best == 0 or flat[at : at + best] == query[i : i + best].tolist()
