"""Readers and sinks on small files."""

from __future__ import annotations

import datetime
import json

from trifold.operators import normalize
from trifold.schemas import DDL, schema
from trifold.sources import files


def test_schemas():
    assert len(DDL) == 8


def test_all_schemas_parse(spark):
    assert [len(schema(n).fields) for n in DDL] == [23, 6, 15, 7, 9, 6, 4, 4]


def test_landing_to_matches(spark, tmp_path):
    from test_operators import item

    (tmp_path / "log.json").write_text("\n".join(json.dumps({"queried_tag": "#AAA", "item": json.loads(item())}) for _ in range(2)))
    raw = files.landing(spark, str(tmp_path))
    assert normalize.matches(normalize.parse(raw)).select("match_id").distinct().count() == 1
    assert files.landing(spark, str(tmp_path), stream=True).isStreaming


def test_dimension_keeps_one_of_each_id(spark, tmp_path):
    spec = {"brawlers": {"Zed": {"id": 1, "class": "Tank", "aliases": ["z"]}, "Ann": {"id": 1, "class": "Support"}, "Bo": {"id": 2, "released": True}}}
    (tmp_path / "d.json").write_text(json.dumps(spec))
    got = {r["id"]: (r["name"], r["class"]) for r in files.dimension(spark, str(tmp_path / "d.json")).collect()}
    assert got == {1: ("Ann", "Support"), 2: ("Bo", None)}


def test_captions_and_jsonl(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:01:05,000 --> 00:01:06,000\n{x}hi <b>all</b>\nthere\n\n2\nbroken\n")
    rows = files.captions(spark, str(tmp_path / "a.srt")).collect()
    assert [(r["start"], r["text"]) for r in rows] == [(65, "hi all there")]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "type": "a"}\n{"id": 2}\n')
    assert sorted(tuple(r) for r in files.jsonl(spark, str(tmp_path / "c.jsonl"), "id int, type string").collect()) == [(1, "a"), (2, None)]
    more = str(tmp_path / "more")
    for rows in ([(1, "a")], [(2, None)]):
        files.append_jsonl(spark.createDataFrame(rows, "id int, type string"), more)
    assert sorted(tuple(r) for r in files.jsonl(spark, more, "id int, type string").collect()) == [(1, "a"), (2, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b|c'), (2, None)], "k int, s string").coalesce(1)
    files.to_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'a "q", b|c'), ("2", None)]
    files.to_json(df, str(tmp_path / "json"), datetime.datetime(2026, 1, 2))
    assert {r["generated"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {"2026-01-02T00:00:00"}
    assert files.markdown(df) == "| k | s |\n|---|---|\n| 1 | a \"q\", b\\|c |\n| 2 |  |"
    assert files.markdown(df.where("k > 5")) == "_no data yet_"
