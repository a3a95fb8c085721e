"""Decontamination, URL filters, personal data, language and quality."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from trifold.llm import decontaminate, language, pii, quality, urls


@pytest.fixture(scope="module")
def items(corpus):
    w = brute.words(corpus[0][1])
    return [(1, " ".join(w[:25])), (2, "one two"), (3, None), (4, ""), (None, "w1 w2"), (6, " ".join(w[3:12])), (6, "X"), (7, " ".join(brute.words(corpus[9][1])[2:14]).upper()), (8, "x")]


def test_decontaminate(spark, frame, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.op5(corpus, [("" if n is None else n, t) for n, t in items])
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in decontaminate.contamination(frame(corpus), bench).collect()}
    assert got == want
    kept = decontaminate.drop_contaminated(frame(corpus), bench)
    assert kept.columns == frame(corpus).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in want.items() if not v[4])


def test_decontaminate_in_blocks(spark, frame, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in decontaminate.find_hits(frame(corpus), bench).withColumn("n", decontaminate.n_covered("spans")).select("doc_id", "n", F.array_sort("items")).collect())
    many = sorted(tuple(r) for r in decontaminate.find_hits(frame(corpus), bench, block_bytes=200).withColumn("n", decontaminate.n_covered("spans")).select("doc_id", "n", F.array_sort("items")).collect())
    assert one == many


def test_decontaminate_in_blocks_keeps_rows(spark, frame, corpus, items, monkeypatch):
    """Repeated and null doc_ids give a row each, and copies in the benchmark don't fill a block."""
    bench = spark.createDataFrame([*items, *[(50, "w1 w2 w3 " * 10)] * 30], "item_id long, text string")
    docs = [*corpus, corpus[0], corpus[0], (None, corpus[0][1]), (None, corpus[9][1]), (None, None), (1, "one two three"), (None, "none of it")]
    rows = lambda **by: sorted(tuple(map(str, r)) for r in decontaminate.find_hits(frame(docs), bench, **by).withColumn("n", decontaminate.n_covered("spans")).select("doc_id", "n_words", "n", F.array_sort("items")).collect())
    one = rows()
    most = []
    make = decontaminate.Items.__init__
    monkeypatch.setattr(decontaminate.Items, "__init__", lambda self, names, texts: most.append(len(names)) or make(self, names, texts))
    assert len(one) == len(docs) and rows(block_bytes=200) == one
    assert len(most) > 1 and max(most) <= len(items)


def test_contaminated_rows_go(spark, frame, corpus, items):
    """By row, in one block and in several, with columns of clashing names."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [*corpus, corpus[0], (None, corpus[0][1]), (None, None), (None, "none of it"), (1, "one two three"), (1, "clean")]
    hit = {k: v[4] for k, v in brute.op5([(k, t) for k, (_, t) in enumerate(docs)], [("" if n is None else n, x) for n, x in items]).items()}
    want = sorted(((d, t) for k, (d, t) in enumerate(docs) if not hit[k]), key=repr)
    df = frame(docs).withColumn("void", F.lit(1)).withColumn("row", F.lit("x"))
    for size in (decontaminate.BLOCK_BYTES, 200):
        kept = decontaminate.drop_contaminated(df, bench, block_bytes=size)
        assert kept.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want


def test_decontaminate_empty(spark, frame, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame(corpus), none).where("contaminated").count() == 0
    assert decontaminate.contamination(frame([]), none).count() == 0


def test_winnowing_guarantee(spark, frame):
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(6)]  # many equal grams
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for k in range(20)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=200))) for k in range(20)]
    want = brute.op5(docs, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d: v[:3] for d, v in want.items()}


URLS = [
    (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "https://example.net/de/", "example.net", "/de/", "net/", "block"), (3, "http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    (4, "x://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), (5, "http://org/fr/", "org", "/fr/", "org/fr/", "allow"), (6, "no scheme/net/", "", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "http://b.net", "b.net", "", None, "allow"),
    (9, "http://b.net?x", "b.net", "", None, "allow"), (10, "a://net/://x", "net", "/://x", "net/", "block"), (11, "", "", "", None, "allow"), (12, "http://fonet/", "fonet", "/", None, "allow"), (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "old", "old") for k, u, *_ in URLS], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in urls.judge(df).select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(URLS, key=repr)
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_urls_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(urls, "MOST_BYTES", 0)
    df = spark.createDataFrame([(k, u) for k, u, *_ in URLS], "page_id long, url string")
    got = sorted((tuple(r) for r in urls.judge(df).select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(URLS, key=repr)


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("pmod(xxhash64(key), 7) = 0")
    cascade = urls.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = universe.withColumn("in", cascade.has(F.col("key")))
    assert got.where("`in` <> (pmod(xxhash64(key), 7) = 0)").count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if ok(k, m.group())] for k, p in BASE.items()}


def test_base_spans():
    rng = random.Random(6)
    bits = ["a", "@", ".", "x.org", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "+1 (502) 555-0303", "10.0.0.1", "é", "\n", "007", "%", "_"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 100_000)["email"] == []


def test_pii_adds_loose_repeats(frame):
    full = [(k, f"call +1 (502) 555-0{k:03d} now") for k in range(40)] + [(100 + k, "order 99887766554 of it") for k in range(5)]
    docs = [*full, (200, "I am at +1 (502) 555-0777, that is 15025550777, " + "word " * 300 + "or 1 502 555 0777."), (201, None), (202, "15025550777")]
    field = pii.fit(frame(docs))
    got = {r["doc_id"]: r for r in pii.find(frame(docs), field).collect()}
    text = docs[45][1]
    assert [text[s["start"] : s["end"]] for s in got[200]["base"]] == ["+1 (502) 555-0777"]
    assert [text[s["start"] : s["end"]] for s in got[200]["added"]] == ["15025550777", "1 502 555 0777"]
    assert got[202]["added"] == [] and got[201]["base"] == [] and all(not got[100 + k]["added"] for k in range(5))
    assert pii.find(frame([]), None).count() == 0 and pii.fit(frame([(1, "none"), (2, None)])) is None


@pytest.mark.parametrize("n", [3, 10, 50, 500])
def test_pii_adds_every_loose_repeat(frame, n):
    full = [(k, f"call +1 (502) 555-0{k:03d} now") for k in range(40)]
    field = pii.fit(frame(full))
    forms = ["15025550777", "1 502 555 0777", "1.502.555.0777"]
    loose = [f"then {forms[k % 3]} again" for k in range(n)]
    for parts in ([*loose[: n // 2], "+1 (502) 555-0777 is mine", *loose[n // 2 :]], ["+1 (502) 555-0777 is mine", *loose]):
        text = ", ".join([*parts, "order 99887766554", "and 99887766554"])
        got = [text[a:b] for _, a, b in sorted(field.added(text, pii.base_spans(text)), key=lambda s: s[1])]
        assert got == [forms[k % 3] for k in range(n)]
    text = ", ".join(loose)  # without a full form there is no evidence
    assert field.added(text, pii.base_spans(text)) == []


def test_pii_candidates():
    """Parts of a number that other numbers hide, endings of longer numbers, whole stretches around a sign."""
    field = pii.learn([x for k in range(40) for x in (f"call +1 (502) 555-0{k:03d} now", "card 4111111111111111", f"order {9807915762804490 + 10 * k}", f"a{k}@b.org")])
    added = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in sorted(field.added(t, pii.base_spans(t)), key=lambda s: s[1])]
    assert added("see 7536784127813050 4845168114407329 there") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert added("see 2353820953013749 4550997810720808 there") == [("card", "4550997810720808")]
    assert added("see 2353820953013749 4845168114407320 there") == []
    assert added("+1 (502) 555-0777, locally 502 555 0777 or 555-0777, not 555-0778") == [("phone", "502 555 0777"), ("phone", "555-0777")]
    long = "x" * 500 + "@" + "y" * 700
    assert pii.Candidates(long, pii.base_spans(long)).spans == [(0, 1201)]
    assert pii.Candidates("é@ü.de, (a@b@c)!", {k: [] for k in pii.KINDS}).keys == ["é@ü.de", "(a@b@c"]


def test_pii_long_text():
    field = pii.learn([f"call +1 (502) 555-0{k:03d} now" for k in range(40)])
    text = "+1 (502) 555-0777 " + "word 15025550777 and 99887766554, x@y " * 3000
    got = field.added(text, pii.base_spans(text))
    assert len(got) == 3000 and {text[a:b] for _, a, b in got} == {"15025550777"}


def plain_beliefs(field, c):
    """Marginals over all labellings of candidates and hubs."""
    import itertools

    import numpy as np

    n, kinds = len(c.spans), len(field.weights)
    pairs, n_hubs = c.hubs()
    node = c.features @ field.weights.T
    out = np.zeros((n, kinds))
    for labels in itertools.product(range(kinds), repeat=n + n_hubs):
        if any(b and labels[i] != b for i, b in enumerate(c.base)) or any(c.base[i] and labels[n + h] != c.base[i] for i, h in pairs):
            continue
        e = sum(node[i, labels[i]] * (not c.base[i]) for i in range(n)) + sum(field.chain[labels[i], labels[i + 1]] for i in range(n - 1)) + sum(field.skip[labels[i], labels[n + h]] for i, h in pairs)
        out[range(n), labels[:n]] += np.exp(e)
    return out / out.sum(axis=1, keepdims=True)


def test_message_passing():
    """Exact without loops; with loops the same labels wherever they are clear."""
    import numpy as np

    rng = np.random.default_rng(3)
    forms = ["+1 (502) 555-0777", "15025550777", "555 0777", "998877665", "a@b", "x@y.org", "1.502.555.0777"]
    clear = 0
    for _ in range(60):
        field = pii.Field(rng.normal(0, 0.7, (5, 12)), rng.normal(0, 0.5, (5, 5)), np.eye(5) * rng.uniform(1, 4))
        text = ", ".join(rng.choice(forms, rng.integers(1, 6)))
        c = pii.Candidates(text, pii.base_spans(text))
        got, want = field.beliefs(c), plain_beliefs(field, c)
        if not len(c.hubs()[0]):
            assert np.allclose(got, want, atol=1e-3)
        sure = want.max(axis=1) > 0.9
        clear += sure.sum()
        assert (got.argmax(axis=1) == want.argmax(axis=1))[sure].all()
    assert clear > 40


def plain_viterbi(score, penalty):
    """Best labels of one text by lists; a tie stays where it is, and the first of equal ends counts."""
    value, back = list(score[0]), []
    for row in score[1:]:
        best = max(range(len(row)), key=lambda k: (value[k], -k))
        back.append([best if value[k] < value[best] - penalty else k for k in range(len(row))])
        value = [max(value[k], value[best] - penalty) + row[k] for k in range(len(row))]
    now = max(range(len(value)), key=lambda k: (value[k], -k))
    out = [now]
    for step in reversed(back):
        now = step[now]
        out.append(now)
    return out[::-1]


def test_viterbi_in_blocks():
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = rng.integers(0, 40, 12)
        first = np.concatenate([[0], np.cumsum(sizes)])
        score = rng.integers(-6, 7, (first[-1], 4)).astype(np.float32)  # many ties, exact sums
        score[rng.random(len(score)) < 0.3] = 0
        want = [x for a, b in zip(first, first[1:], strict=False) if b > a for x in plain_viterbi(score[a:b].tolist(), 6.0)]
        for block in (1, 3, 7, 512):
            assert language.viterbi(score, first, 6.0, block).tolist() == want
    assert len(language.viterbi(np.zeros((0, 4), np.float32), np.zeros(3, np.int64))) == 0
    began = time.perf_counter()
    language.viterbi(rng.random((300_000, 4)).astype(np.float32), np.array([0, 300_000]))
    assert time.perf_counter() - began < 8


WORDS = {
    "en": "the and of to in government announced negotiations with station yesterday morning that will internationalisation",
    "ru": "и в на что правительство объявило переговоры вчера утром станция достопримечательность человеконенавистничество",
    "uk": "і в на що уряд оголосив переговори вчора вранці їхати станція достовірність її",
    "el": "και το της κυβέρνηση ανακοίνωσε διαπραγματεύσεις χθες σταθμός ηλεκτροεγκεφαλογράφημα",
    "zh": "政府 宣布 谈判 昨天 上午 车站 的 和",
}


def scripts_table(spark, more=()):
    import random

    rng = random.Random(1)
    rows = [(k * 100 + i, lang, " ".join(rng.choice(WORDS[lang].split()) for _ in range(40))) for k, lang in enumerate(WORDS) for i in range(30)]
    return spark.createDataFrame([*rows, *more], "doc_id long, lang string, text string")


def plain_words(model, text):
    """Words of a text as (start, end, scores by language or None where the script rules it out), byte by byte."""
    raw = text.encode()
    low = language.letters(np.frombuffer(raw, np.uint8)).tolist()
    out, at = [], 0
    while at < len(low):
        if low[at] == 0x20:
            at += 1
            continue
        end = at
        while end < len(low) and low[end] != 0x20:
            end += 1
        get = lambda i: low[i] if 0 <= i < len(low) else 0x20  # noqa: B023, E731
        score, script = [0.0] * len(model.langs), 0
        for i in range(at, end):
            g = (get(i - 1) * 0x9E5 + get(i) * 0x1F35B + get(i + 1) * 0x3D) * 0x9E3779B1 % (1 << 32) >> 16
            score = [s + float(x) for s, x in zip(score, model.table[g], strict=True)]
            first = max(lead for lead, _ in language.SCRIPTS if lead <= raw[i]) if raw[i] < 0x80 or raw[i] >= 0xC0 else 0
            script = max(script, [lead for lead, _ in language.SCRIPTS].index(first))
        known = [bool(x) for x in model.allowed[script]]
        out.append((at, end, [(s if k else -np.inf) for s, k in zip(score, known, strict=True)] if any(known) else [0.0] * len(known)))
        at = end
    return out


def test_words_against_bytes(spark):
    model = language.fit(scripts_table(spark))
    texts = ["", "The cat, 12 и станция...", "правительство объявило переговоры with the Government", "x" * 60 + " " + "ж" * 60, "谈判αβ 🙂 “q” é", "κυβέρνηση", "שלום the", "  ", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    starts, ends, first, score = model.words(raw, offs)
    want = [(offs[k] + a, offs[k] + b, s) for k, t in enumerate(texts) for a, b, s in plain_words(model, t)]
    assert [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)] == [(a, b) for a, b, _ in want]
    for got, (_, _, s) in zip(score, want, strict=True):
        assert got == pytest.approx(s, rel=1e-4)
    label = language.viterbi(score, first)
    for k in range(len(texts)):
        a, b = first[k], first[k + 1]
        if b > a:
            assert label[a:b].tolist() == plain_viterbi(score[a:b].tolist(), language.PENALTY)


def test_scripts(spark):
    """Texts of one script each, whole and in a row; no language that a script rules out is ever given."""
    model = language.fit(scripts_table(spark, [(9001, "zz", "word " * (language.LONGEST // 4)), (9002, "yy", "12 !"), (9003, "xx", None), (None, "ww", "a text")]))
    assert model.langs == sorted(WORDS)
    texts = {lang: " ".join(reversed(w.split())) for lang, w in WORDS.items()}
    longest = {"en": "a" * 60, "el": "α" * 60, "zh": "政" * 60}
    rows = [(k, t) for k, t in enumerate([*texts.values(), *longest.values()])]
    rows += [(100, ". ".join([texts["en"], texts["ru"], texts["el"], texts["zh"]])), (101, "правительство объявило переговоры"), (102, "שלום עולם")]
    got = {r["doc_id"]: r for r in language.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k]["lang_pred"] for k in range(len(rows) - 3)] == [*texts, *longest]
    assert [s["lang"] for s in got[100]["spans"]] == ["en", "ru", "el", "zh"]
    assert got[101]["lang_pred"] in ("ru", "uk") and got[102]["lang_pred"] in model.langs
    for k, (lang, text) in enumerate(texts.items()):
        assert got[k]["score"] > 0.9, text


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rows = language.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    en, de = (docs.where(f"lang = '{x}' AND n_chars > 400").orderBy("doc_id").first()["text"][:300] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en + " " + de), (2, None), (3, "123 !?"), (4, "日本"), (5, ""), (1, en + " " + de)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.label(mixed, model).collect()}
    spans = got[1]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["end"] - 300) < 40
    assert (got[2]["lang_pred"], got[3]["lang_pred"], got[5]["lang_pred"]) == ("und", "und", "und") and got[4]["lang_pred"] in model.langs
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = {r["lang_pred"] for r in language.label(mixed, language.fit(docs.where("lang IS NULL"))).collect()}
    assert none == {"und"}
    assert language.label(mixed.limit(0), model).count() == 0


def test_quality(spark, sf, frame):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality.fit(docs, labels)
    rows = quality.scores(docs, net).join(labels, "doc_id").where(quality.held_out()).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    odd = [(1, None), (2, ""), (3, "x"), (4, "long text " * 60_000), (3, "x")]
    got = quality.scores(frame(odd), net).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    kept = quality.keep_good(frame(odd), labels)
    assert kept.columns == frame(odd).columns
    none = labels.where("quality = 7")
    assert quality.fit(docs, none) == 0.5 and quality.fit(docs, labels.where("quality = 1")) == 1.0
    assert quality.scores(frame([]), net).count() == 0


def test_quality_slices_agree():
    import numpy as np

    net = quality.Net(np.random.default_rng(0))
    raw = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    whole = net.pooled(raw, most=quality.STEP * 1000)[0]
    parts = net.pooled(raw, most=quality.STEP * 3)[0]
    assert np.allclose(whole.max(axis=0), parts.max(axis=0))
    assert np.allclose(whole.max(axis=0), net.responses(raw).max(axis=0))


def test_quality_against_loops():
    """Responses, pooling over overlapping chunks and the score by plain loops."""
    import math

    import numpy as np

    net = quality.Net(np.random.default_rng(5))
    net.bias[:] = np.linspace(-1, 1, quality.FILTERS)
    for size in (0, 1, 4, 5, 6, 200, 256, 257, 261, 480, 484, 485, 1000):
        raw = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
        padded = raw.tolist() + [0] * max(0, quality.WIDTH - size)
        places = len(padded) - quality.WIDTH + 1
        response = [[sum(float(net.table[j][padded[i + j]][f]) for j in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(places)]
        last = 0
        while last + quality.CHUNK < places:  # chunks begin STEP apart until one reaches the end
            last += quality.STEP
        tops = [[max(r[f] for r in response[s : s + quality.CHUNK]) for f in range(quality.FILTERS)] for s in range(0, last + 1, quality.STEP)]
        act = [[math.tanh(t + float(b)) for t, b in zip(row, net.bias, strict=True)] for row in tops]
        x = [sum(c) / len(act) for c in zip(*act, strict=True)] + [max(c) for c in zip(*act, strict=True)]
        z = sum(a * float(w) for a, w in zip(x, net.out, strict=True)) + float(net.out_bias)
        assert net.score(raw) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4), size


def test_fits_read_one_text_of_a_repeated_document(frame):
    rows = [(1, "the cat mails a@b.de at 10.0.0.1")] * 50 + [(2, "other"), (None, "x")]
    once = language.fit(frame(rows[:1] + rows[50:]))
    assert (language.fit(frame(rows)).table == once.table).all()
    assert (pii.fit(frame(rows)).weights == pii.fit(frame(rows[:1] + rows[50:])).weights).all()
