"""Bookkeeping of the poll loop: batches that run twice, snapshots, lookups and stops."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trifold.streaming import enrich

SCHEMA = "tag string, epoch long, new_matches int"


def rows(df):
    return {r["tag"]: (r["polls"], r["new_matches"], r["last_poll"], r["ranked_rank"], r["enriched_at"]) for r in df.collect()}


BATCHES = [
    [("#A", 10, 5), ("#B", 11, None), (None, 12, 9), ("#A", 9, 1)],
    [("#C", 20, 30), ("#A", 21, 0)],
    [("#D", 30, 7), ("#B", 31, 2)],
    [],
    [("#A", 50, 1)],
]


def fetch(asked):
    def of(queue):
        tags = sorted(r["tag"] for r in queue.collect())
        asked.append(tags)
        return queue.where("tag <> '#C'").withColumn("ranked_rank", F.ascii(F.substring("tag", 2, 1)))

    return of


def play(spark, base, order, asked):
    put = enrich.put(base, 2, 2, 25, fetch(asked))
    for k in order:
        put(spark.createDataFrame(BATCHES[k], SCHEMA), k)
    return rows(enrich.before(spark, base))


def test_a_batch_twice_changes_nothing(spark, tmp_path):
    once, asked = play(spark, str(tmp_path / "a"), range(5), one := []), one
    twice = play(spark, str(tmp_path / "b"), [0, 0, 1, 1, 2, 3, 3, 4, 4], [])
    assert once == twice
    # After batch 1 the two most active are asked for; #C isn't found and comes first again.
    assert asked == [["#A", "#C"], ["#C", "#D"]]
    assert once == {"#A": (4, 7, 50, 65, 21), "#B": (2, 2, 31, None, None), "#C": (1, 30, 20, None, None), "#D": (1, 7, 30, 68, 31)}


def test_stale_lookups_are_repeated(spark, tmp_path):
    base, asked = str(tmp_path), []
    put = enrich.put(base, 1, 5, 25, fetch(asked))
    for k, at in enumerate((10, 30, 60)):
        put(spark.createDataFrame([("#A", at, 1)], SCHEMA), k)
    assert asked == [["#A"], [], ["#A"]]
    assert rows(enrich.before(spark, base)) == {"#A": (3, 3, 60, 65, 60)}


def test_tidy_keeps_the_table(spark, tmp_path):
    base = str(tmp_path)
    want = play(spark, base, range(5), [])
    enrich.tidy(spark, base, 4)
    assert rows(enrich.before(spark, base)) == want
    assert sorted(p.name for p in (tmp_path / "added").iterdir()) == ["batch=4"] and [p.name for p in (tmp_path / "snapshot").iterdir()] == ["batch=3"]
    # Batch 4 can still run again.
    enrich.put(base, 2, 2, 25, fetch([]))(spark.createDataFrame(BATCHES[4], SCHEMA), 4)
    assert rows(enrich.before(spark, base)) == want


def test_nothing(spark, tmp_path):
    assert enrich.before(spark, str(tmp_path / "none")) is None
    enrich.put(str(tmp_path), 1, 5, 25, fetch([]))(spark.createDataFrame([], SCHEMA), 0)
    assert rows(enrich.before(spark, str(tmp_path))) == {}


@pytest.mark.parametrize("stops", [[5], [2, 5]])
def test_stream_goes_on(spark, tmp_path, stops):
    source, base = tmp_path / "in", str(tmp_path / "base")
    source.mkdir()
    done = 0
    for upto in stops:
        for k in range(done, upto):
            spark.createDataFrame([(f"#{x}", 100 * k + x, x) for x in range(3)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
            (part,) = (tmp_path / f"t{k}").glob("*.parquet")
            part.rename(source / f"{k}.parquet")
        done = upto
        polls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = enrich.run(polls, base, lambda q: q.withColumn("ranked_rank", F.lit(7)), every=2, limit=1, age=10_000)
    got = rows(out)
    assert {t: r[:3] for t, r in got.items()} == {f"#{x}": (5, 5 * x, 400 + x) for x in range(3)}
    assert [got[f"#{x}"][3] for x in range(3)] == [None, 7, 7]  # batches 1 and 3 looked up one each
