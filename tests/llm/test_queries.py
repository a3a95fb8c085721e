"""The ``opN_`` queries themselves: their columns, types and digests on a small table with odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import brute
import pytest
from test_filters import URLS, plain_base

from trifold.llm import pii, registry


@pytest.fixture(scope="module")
def rows(corpus):
    pii_text = "mail a.b@c.org or 10.0.0.1, +1 (502) 555-0777 = 15025550777; 4111 1111 1111 1111. See é 7536784127813050 4845168114407329"
    return [*corpus, (900, pii_text), (901, "no\nletters 12"), (902, "12 34"), (903, "a" * 30_000)]


@pytest.fixture(scope="module")
def folder(spark, rows, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    langs = ["en", "de", None]
    docs = spark.createDataFrame([(d, t, langs[d % 3], "s", 1, 0.5, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d, _ in rows if d % 3], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(brute.words(corpus[0][1])[:25])), (2, "one two"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, u) for k, u, *_ in URLS], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return at


TYPES = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_token_counts": "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_chars bigint, n_chars_encoded bigint",
    "op5_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


def run(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    want = TYPES[name].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema][: len(want)] == want
    return df.collect()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1(spark, folder, rows):
    assert {r["doc_id"]: tuple(r)[1:4] for r in run(spark, folder, "op1_substring_dedup")} == brute.op1(rows)


def test_op2(spark, folder, rows):
    got = run(spark, folder, "op2_language")
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        letters = re.search(r"[^\W\d_]", text[r["doc_id"]] or "")
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] in {"en", "de"}) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_op3(spark, folder, rows):
    want = brute.op3(rows)
    for r in run(spark, folder, "op3_exact_dedup"):
        plain = re.sub(r"[\x20\x09-\x0D]+", "", dict(rows)[r["doc_id"]] or "")
        assert (r["keep_id"], r["group_size"]) == tuple(want[r["doc_id"]]) and r["kept"] == (r["keep_id"] == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(plain.encode()).hexdigest()


def test_op4(spark, folder, rows):
    from tokenizers import Tokenizer

    from trifold.llm import counts, tokens

    encode = Tokenizer.from_file(tokens.default_path()).encode
    size = lambda t: len(encode(t, add_special_tokens=False).ids)
    for r in run(spark, folder, "op4_token_counts"):
        text = dict(rows)[r["doc_id"]] or ""
        after = text
        for a, b, new in sorted(counts.cleaning(text), reverse=True):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_tokens_after"], r["n_chars"]) == (size(text), size(after), len(text))


def test_op5(spark, folder, rows, corpus):
    want = brute.op5(rows, [("1", " ".join(brute.words(corpus[0][1])[:25])), ("2", "one two"), ("3", None)])
    assert {r["doc_id"]: tuple(r)[1:6] for r in run(spark, folder, "op5_decontaminate")} == want


def test_op6(spark, folder, rows):
    got = run(spark, folder, "op6_pii")
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        base = plain_base(text)
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert tuple(r)[1:5] == tuple(len(base[k]) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans) and {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans} >= set(listed)
        if r["doc_id"] == 900:
            assert [text[a:b] for k, a, b in spans if f"{pii.KINDS[k]}:{a}:{b}" not in listed] == ["15025550777"]


def test_op7(spark, folder, rows):
    from test_tokens import PATH, check_pieces
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(PATH).encode
    check_pieces(run(spark, folder, "op7_packing"), rows, lambda t: encode(t, add_special_tokens=False).ids)


def test_op8(spark, folder, rows):
    prints = {d: brute.simhash(t) for d, t in rows}
    want = brute.classes(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op8_simhash")} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_op9(spark, folder):
    got = sorted((tuple(r)[:5] for r in run(spark, folder, "op9_url_filter")), key=repr)
    assert got == sorted(((k, h, p, r, v) for k, _, h, p, r, v in URLS), key=repr)


def test_op10(spark, folder, rows):
    got = run(spark, folder, "op10_quality")
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
