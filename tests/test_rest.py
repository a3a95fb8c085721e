"""The client and the data source against transports that need no network."""

from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle

from trifold.plans import streams
from trifold.sources import rest

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def client(transport, **more):
    clock = Clock()
    return clock, rest.Client(transport, clock=clock, sleep=clock.sleep, seed=1, **more)


def test_pace_is_held():
    at = []
    clock, c = client(lambda p: at.append(clock()) or (200, "x"), rate=2.0)
    for _ in range(10):
        c.get("/a")
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(at, at[1:], strict=False)) and at[-1] == pytest.approx(4.5)
    clock.now += 100  # a pause saves up one token, no more
    for _ in range(3):
        c.get("/a")
    assert at[-1] - at[-3] >= 1.0 - 1e-9


def test_retries_with_jitter():
    calls = []
    clock, c = client(lambda p: calls.append(p) or (500, ""), rate=1e9)
    assert c.get("/a")[:3] == (500, None, 6) and c.get("/a")[4] == "HTTP 500" and len(calls) == 12
    for _ in range(200):
        c.get("/a")
    waits = [w for w in clock.waits if w > 1e-6]
    assert all(w <= 16 * 0.5 for w in waits) and max(waits) > 6 and len({round(w, 6) for w in waits}) > 900
    waits = iter([429, 503, 200])
    assert client(lambda p: (next(waits), "ok"), rate=1e9)[1].get("/b")[:3] == (200, "ok", 3)


def test_answers_and_refusals():
    calls = []
    assert client(lambda p: calls.append(p) or (404, "gone"))[1].get("/a")[:3] == (404, None, 1)
    for status in (401, 403):
        with pytest.raises(rest.Refused):
            client(lambda p, s=status: calls.append(p) or (s, ""))[1].get("/b")
    assert len(calls) == 3

    def broken(path):
        raise ConnectionError("no route")

    assert client(broken, rate=1e9, retries=2)[1].get("/a")[::4] == (0, "no route")


def server(path):
    if path == "/next":
        return 200, "25"
    k = int(path.rsplit("/", 1)[1])
    return (404, "") if k % 10 == 3 else (200, f"item {k}")


def test_batch(spark):
    rest.register(spark, "items", server)
    df = spark.read.format("items").options(resource="/v1/items/{key}", first=0, end=23, rate=1e6, parts=4).load()
    assert df.rdd.getNumPartitions() == 4
    got = {int(r["key"]): (r["status"], r["body"], r["error"]) for r in df.collect()}
    assert got == {k: ((404, None, None) if k % 10 == 3 else (200, f"item {k}", None)) for k in range(23)}
    assert spark.read.format("items").options(first=5, end=5).load().count() == 0


def test_refusal_ends_the_job(spark):
    rest.register(spark, "closed", lambda path: (403, ""))
    with pytest.raises(Exception, match="isn't accepted"):
        spark.read.format("closed").options(end=3, rate=1e6).load().count()


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    rest.register(spark, "items", server)
    base = str(tmp_path / "out")
    load = lambda **more: spark.readStream.format("items").options(resource="/v1/items/{key}", first=0, rate=1e6, parts=3, **more).load()
    first = streams.run(load(end=10), "append", base).collect()
    assert sorted(int(r["key"]) for r in first) == list(range(10))
    both = streams.run(load(head="/next", per_trigger=6), "append", base).collect()
    assert sorted(int(r["key"]) for r in both) == sorted(int(r["key"]) for r in first) + [k for k in range(10, 10 + len(both) - 10)] and len(both) > 10


def test_fetch(spark):
    asked = spark.range(30).selectExpr("id AS key", "concat('/x/', id) AS path")
    got = {r["key"]: r["status"] for r in rest.fetch(asked, server, rate=1e6, parts=3).collect()}
    assert got == {str(k): 404 if k % 10 == 3 else 200 for k in range(30)}


def test_others_go_on_while_one_waits():
    """Requests that fail at first wait side by side, in one client's batch."""
    failed = set()

    def server(path):
        if path not in failed and int(path) % 2:
            failed.add(path)
            return 503, ""
        return 200, path

    clock, c = client(server, rate=1e9)
    paths = [str(k) for k in range(200)]
    got = c.get_all(paths)
    assert [(r[0], r[1], r[2]) for r in got] == [(200, p, 1 + int(p) % 2) for p in paths]
    assert clock.now < 2 * rest.FIRST_WAIT  # one after the other they take 25 s on average


def test_page_server_reads_blocks_once(spark, sf, monkeypatch):
    """A run through the pages in order reads each block of the server's store once."""
    import pyarrow.parquet as pq

    from trifold.sources import bind

    monkeypatch.setattr(bind, "PAGES_A_READ", 1024)
    get, reads, read = bind.page_server(spark, sf), [], pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, *a, **k: reads.append(1) or read(self, *a, **k))
    pages = {r["page_id"]: r["html"] for r in bind.table(spark, sf, "pages").collect()}
    for k in sorted(pages):
        status, body = get(f"/pages/{k}")
        if status == 503:
            status, body = get(f"/pages/{k}")
        assert (status, body) == ((404, "") if k % 10 == 3 else (200, pages[k]))
    assert get(f"/pages/{max(pages) + 10 + (max(pages) % 10 == 3)}")[0] in (404, 503) and 1 <= len(reads) < len(pages) / 2
