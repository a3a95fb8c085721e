"""Tokens, edit-aware counts, packing and the pipeline."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from trifold.llm import counts, packing, tokens
from trifold.llm.common import stored

PATH = tokens.default_path()


@pytest.fixture(scope="session")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = st.text(alphabet=st.sampled_from("ab cdé'stre \n\t1234.,!?日本🙂'll  |<>"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_same_ids_and_safe_cuts(reference, text):
    assert tokens.encode(text, PATH).tolist() == reference(text)
    assert tokens.encode(text, PATH, step=3).tolist() == reference(text)


def test_documents_have_the_same_ids(spark, sf, reference):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert tokens.encode(r["text"], PATH, step=500).tolist() == reference(r["text"])
    assert tokens.encode("<|endoftext|> a", PATH).tolist() == reference("<|endoftext|> a")


ADDED = st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", "b c", " ", "  ", "\n", ".", "é"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(ADDED, st.integers(0, 60), st.integers(0, 12), ADDED)
def test_added_tokens_have_their_ids(text, start, size, new):
    plain = Tokenizer.from_file(PATH)  # at its defaults
    want = lambda t: plain.encode(t, add_special_tokens=False).ids
    assert tokens.ids(text, PATH).tolist() == tokens.ids(text, PATH, step=3).tolist() == want(text)
    monkey, counts.LEAF = counts.LEAF, 4
    try:
        tree = counts.Tree(text, PATH)
        assert tree.total() == len(want(text))
        start = min(start, len(text))
        end = min(start + size, len(text))
        tree.edit(start, end, new)
        assert tree.total() == len(want(text[:start] + new + text[end:]))
    finally:
        counts.LEAF = monkey


def test_packing_of_added_tokens(frame):
    plain = Tokenizer.from_file(PATH)
    docs = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext"), (4, "one. " * 900 + "<|endoftext|>")]
    check_pieces(packing.pack(frame(docs)).collect(), docs, lambda t: plain.encode(t, add_special_tokens=False).ids)
    got = {r["doc_id"]: r["n_tokens"] for r in counts.recount(counts.trees(frame(docs)), counts.cleaning).collect()}
    assert got == {d: len(plain.encode(t, add_special_tokens=False).ids) for d, t in docs}


@settings(max_examples=150, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 12), ALPHABET), max_size=6))
def test_edits_one_after_another(text, edits):
    monkey, counts.LEAF = counts.LEAF, 4
    try:
        tree = counts.Tree(text, PATH)
        for start, size, new in edits:
            start = min(start, len(text))
            end = min(start + size, len(text))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert "".join(tree.leaves) == text
            assert tree.total() == len(tokens.encode(text, PATH))
    finally:
        counts.LEAF = monkey


def test_recount(spark, frame, corpus):
    got = {r["doc_id"]: r for r in counts.recount(counts.trees(frame(corpus)), counts.cleaning).collect()}
    for d, t in corpus:
        t = t or ""
        assert got[d]["n_tokens"] == len(tokens.encode(t, PATH))
        for a, b, new in sorted(counts.cleaning(t), reverse=True):
            t = t[:a] + new + t[b:]
        assert got[d]["n_tokens_after"] == len(tokens.encode(t, PATH))
    long = " ".join(f"word{k % 97}" for k in range(20_000))
    trees = counts.trees(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    edited = trees.selectExpr("*", "array(named_struct('start', 500L, 'end', 504L, 'text', 'new words')) AS edits")
    r = counts.recount(edited).first()
    assert r["n_tokens_after"] == len(tokens.encode(long[:500] + "new words" + long[504:], PATH)) and r["n_chars_encoded"] < 2500
    assert counts.recount(trees.selectExpr("*", "CAST(NULL AS array<struct<start:long,end:long,text:string>>) AS edits")).first()["n_edits"] == 0
    assert counts.recount(counts.trees(frame([])), counts.cleaning).count() == 0


def check_pieces(rows, docs, reference):
    """Every id in one piece, sequences gapless and at most full; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == sorted(d for d, _ in docs)
    for d, text in docs:
        ids = np.array([*reference(text or ""), 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def test_packing(frame, corpus, reference):
    rows = packing.pack(frame(corpus)).collect()
    padding = check_pieces(rows, corpus, reference)
    assert padding < 0.01 * sum(r["length"] for r in rows)
    assert packing.pack(frame([])).count() == 0
    twice = packing.pack(frame([(1, "a b"), (1, "a b")])).collect()
    assert sum(r["length"] for r in twice) == 2 * (len(reference("a b")) + 1)


def test_packer_of_random_lengths():
    rng = random.Random(2)
    packer = packing.Packer(5)
    total = 0
    for d in range(400):
        n = rng.choice([1, 63, 64, 65, 2047, 2048, 2049, rng.randint(1, 9000)])
        total += n
        packer.add(d, np.arange(n, dtype=np.uint32))
    packer.finish()
    size = {}
    for _, _, n, _, _, s, _ in packer.done:
        size[s] = size.get(s, 0) + n
    assert sum(size.values()) == total and min(size) == 5
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values())
    assert padding < 0.005 * total


def test_pipeline_stages(spark, sf, reference):
    """Each stage against a plain version of it, on its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        out = stage(spark, docs, "/root/testdata/sf0.01")
        if name == "packing":
            check_pieces(out.collect(), before, reference)
            break
        assert out.columns == columns
        after = sorted(r["doc_id"] for r in out.collect())
        if name == "quality classifier":
            assert set(after) < {d for d, _ in before} and len(after) > 0.7 * len(before)
        elif name == "exact dedup":
            assert after == sorted({k for k, _ in brute.op3(before).values()})
        elif name == "simhash near-dedup":
            assert after == [before[i][0] for i in brute.near(before)]
        else:
            assert after == sorted(d for d, v in brute.op5(before, bench).items() if not v[4])
        docs = stored(out)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty documents or labels, null and repeated doc_ids, null texts, extra columns."""
    rng = random.Random(5)
    good = [(k, " ".join(f"w{rng.randrange(997)}" for _ in range(60)), 0) for k in range(30)]
    odd = [(1, good[1][1], 1), (None, good[2][1], 1), (None, "lone words here", 1), (None, None, 1), (7, "other text of seven", 1), (7, None, 1), (90, "", 1)]
    labels = [(k, k % 2, 0) for k in range(30)]
    for n, (docs, known) in enumerate([([*good, *odd], labels), ([*good, *odd], []), ([], labels), ([], [])]):
        at = f"{tmp_path}/{n}"
        spark.createDataFrame(docs, "doc_id long, text string, score int").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, good[3][1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        left = spark.read.parquet(f"{at}/documents.parquet")
        sizes = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stored(stage(spark, left, at))
            assert left.columns == ["doc_id", "text", "score"]
            sizes.append(left.count())
        assert sizes == sorted(sizes, reverse=True)
        if docs and not known:  # nothing is rejected without labels: one copy of each text stays, and no text of the benchmark
            assert sizes[0] == len(docs) and sizes[1] == len({t or "" for _, t, _ in docs}) and sizes[3] == sizes[2] - 1
        assert corpus_pipeline.run(spark, at).count() >= sizes[-1]
