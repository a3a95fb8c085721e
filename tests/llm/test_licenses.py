"""Licence scans against every start of every text."""

from __future__ import annotations

import random
import re

import brute
import pytest
from compare import connect, spark_rows, sql_rows

from trifold.llm import licenses

LABELS = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(rows):
    out = []
    for d, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t))
        base, found, score = [], set(), 0.0
        for x in licenses.TEMPLATES:
            tw = x.text.split()
            get = lambda i: w[i] if 0 <= i < len(w) else None  # noqa: B023, E731
            for b in range(-len(tw), len(w)):
                if all(get(b + at) == word for word, at in x.places()):
                    share = sum(get(b + j) == tw[j] for j in range(len(tw))) / len(tw)
                    score = max(score, share)
                    found |= {x.label} if share >= 0.8 else set()
        for phrase, label in LABELS.items():
            p = phrase.split()
            base += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in base]
        own = {x for _, x in base}
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(found | own)), score))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(6)
    rows = [*corpus, (900, "Under the MIT License, under the mit-license; UNDER THE M.I.T. license"), (901, "cc by nc cc by nc by nc"), (902, "Apache License, Version 2.0"), (903, "apache license version 20 under the mit licenseé"), (904, "mit license"), (905, "the mit license")]
    for k, x in enumerate(licenses.TEMPLATES):
        w = x.text.split()
        rows += [(1000 + k, x.text.title()), (1100 + k, " ".join(w[1:])), (1200 + k, "so " + ", ".join(v if rng.random() < 0.8 else "other" for v in w) + " end"), (1300 + k, "\n".join([x.text] * 3)), (1400 + k, " ".join(w[: len(w) // 2]))]
    for d in range(2000, 2100):
        rows.append((d, " ".join(rng.choice(["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "gnu", "public", "general"]) for _ in range(200))))
    return [*rows, rows[-1], (None, "cc-by-nc"), (905, "an id again, under the mit license")]


def test_whole(spark, frame, texts, tmp_path):
    frame(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op13_licenses(spark, str(tmp_path))
    want = [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == want
    assert sorted(map(tuple, got.collect()), key=repr) == plain(texts)
    distinct = {r[0]: r for r in texts}
    spark.createDataFrame(list(distinct.values()), "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert spark_rows(licenses.op13_licenses(spark, f"{tmp_path}/b")) == sql_rows(connect(f"{tmp_path}/b"), licenses.ORACLE["op13_licenses"])


def test_plan_has_no_python(spark, frame, texts):
    plan = licenses.scan(frame(texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hashpartitioning", plan)


def test_columns(spark, frame):
    row = licenses.scan(frame([(1, "Under the MIT license")]).withColumnRenamed("spans", "labels")).first()
    assert (row["labels"], row["digest"], row["score"]) == ("mit", "en", 1.0)
    assert [(p["label"], p["word"], p["share"]) for p in row["places"]] == [("mit", 0, 1.0)]
    assert licenses.scan(frame([])).collect() == []


def test_template_needs_its_phrase():
    with pytest.raises(ValueError):
        licenses.Template("x", "a b c", ("c d",)).places()
    with pytest.raises(ValueError):
        licenses.Template("x", "a b c", ("c",)).places()
