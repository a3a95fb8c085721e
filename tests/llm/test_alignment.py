"""Token alignment against a plain version that encodes whole texts with the libraries themselves."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trifold.llm import alignment, tokens

ODD = ["", None, " ", "\n", "  two  blanks ", "a\nb\n\nc d\r\ne\tf", "▁", "a ▁b c", "x" * 3000, "<s> </s> <|endoftext|> <0x41>", "\x00 \x85 \xa0 é é 漢字 🙂🙂", "ﬁ ½ Ａ", "\nfoo bar\n", "don't  don't it's", "a \x1c b", "tab\there  \n x"]


def plain(rows):
    """doc_id -> the contract's columns, from whole texts."""
    a, b = Tokenizer.from_file(tokens.default_path()), sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
    a.encode_special_tokens = True
    byte, piece = alignment.byte_tokens(tokens.default_path()), alignment.pieces_of(alignment.piece_path()).bytes
    per, held = [], Counter()
    for d, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spelled = (" " + t).encode() if t else b""
        if b"".join(byte[i] for i in x) != spelled or b"".join(piece[i] for i in y) != spelled:
            x, y = [], []
        ends = [0, 0]
        groups, at = [], [0, 0]
        now = ([], [])
        while at[0] < len(x) or at[1] < len(y):
            k = 0 if ends[0] <= ends[1] and at[0] < len(x) else 1
            ids, of = ((x, byte), (y, piece))[k]
            now[k].append(ids[at[k]])
            ends[k] += len(of[ids[at[k]]])
            at[k] += 1
            if ends[0] == ends[1]:
                groups.append(now)
                now = ([], [])
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        held.update(links.keys())
        per.append((d, x, y, groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    shown = lambda gs: hashlib.sha256(";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in gs).encode()).hexdigest() if gs else ""
    return [
        (d, len(x), len(y), len(gs), sum(ls.values()), sum(n for p, n in ls.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in ls.items()), shown(gs))
        for d, x, y, gs, ls in per
    ], held


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(5)
    more = ["".join(rng.choice("ab \n.é▁漢🙂'1") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [*corpus, *enumerate(ODD, 500), *enumerate(more, 1000)]
    return [*rows, rows[3], (None, "null id text"), (500, "an id again")]


def test_whole(spark, frame, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "FEW_PAIRS", 10)  # pairs return to their postings by a join
    frame(texts).write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = plain(texts)
    got = alignment.op12_alignment(spark, str(tmp_path))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", *[f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], "groups_sha256 string"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_counts(spark, frame, texts):
    _, held = plain(texts)
    counts = alignment.Index(frame(texts)).counts()
    rows = counts.collect()
    assert {(r["a"], r["b"]): r["count"] for r in rows} == dict(held)
    want, _ = plain(texts)
    assert sum(r["links"] for r in rows) == sum(w[4] for w in want)
    assert all(r["best"] == (r["count"] == max(x["count"] for x in rows if x["a"] == r["a"])) for r in rows[::50])


def test_empty(spark, frame):
    assert alignment.Index(frame([])).scores().collect() == []


def test_bitmaps():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(alignment.BLOCK, k, replace=False)) for k in (0, 1, 5, 63, 64, 65, 1024, 0, 300)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = alignment.containers(owner, np.concatenate(sets), len(sets))
    assert max(len(b) for b in bits.to_pylist()) == alignment.FULL
    for part, first in ((bits, 0), (bits.slice(4, 3), 4)):
        got_owner, got = alignment.members(part)
        for k in range(len(part)):
            assert got[got_owner == k].tolist() == sets[first + k].tolist()


def test_merge_spans_batches():
    import pyarrow as pa

    rows = [(1, 0, 0, [1]), (1, 0, 0, [2, 3]), (1, 0, 0, [3, 900]), (1, 0, 1, [2]), (1, 4, 0, list(range(100))), (1, 4, 0, list(range(90, 200))), (2, 0, 0, [7])]
    def batch(rs):
        owner = np.repeat(np.arange(len(rs)), [len(r[3]) for r in rs])
        bits = alignment.containers(owner, np.concatenate([r[3] for r in rs]).astype(np.int64), len(rs))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rs]), pa.array([r[1] for r in rs]), pa.array([r[2] for r in rs], pa.int32()), bits], names=["pair", "block", "plane", "bits"])

    for step in (1, 2, 3, 7):
        out = pa.Table.from_batches(list(alignment._merge([batch(rows[i : i + step]) for i in range(0, len(rows), step)])))
        owner, place = alignment.members(out.column("bits").combine_chunks())
        assert out.column("n").to_pylist() == [4, 1, 200, 1]
        assert [place[owner == k].tolist() for k in (0, 1, 3)] == [[1, 2, 3, 900], [2], [7]]
