"""A paced, retrying client of an HTTP resource, as a Spark data source in batch and stream, and as an operator on requests.

A transport is a function from a path to (status, body); ``http`` makes one.  The
rate is shared out among partitions, so that all together keep to it whenever they
run.  A request that fails is tried again after a wait drawn from 0 to an end that
doubles (full jitter); others go on meanwhile.  401 and 403 end the job: no retry mends a key.  404 is an
answer: a row with a null body.  A request that failed for good is a row with its
last status and the error.
"""

from __future__ import annotations

import heapq
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Requests a second, retries, and seconds of the first and of the longest wait.
RATE, RETRIES, FIRST_WAIT, LONGEST_WAIT = 2.0, 5, 0.5, 30.0
SCHEMA = "key string, status int, body string, attempts int, latency_ms long, error string"
Transport = Callable[[str], tuple[int, str]]


class Refused(RuntimeError):
    """The key or the address isn't accepted."""


def http(base: str, token: str | None = None, timeout: float = 30.0) -> Transport:
    """Requests below ``base``, with a bearer token if there is one."""

    def get(path: str) -> tuple[int, str]:
        head = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, headers=head), timeout=timeout) as answer:
                return answer.status, answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    return get


class Bucket:
    """Tokens for ``rate`` requests a second, ``burst`` of them at most at once."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, now + wait
        self.tokens -= 1


class Client:
    """One partition's requests, in order."""

    def __init__(self, transport: Transport, rate: float = RATE, retries: int = RETRIES, clock=time.monotonic, sleep=time.sleep, seed: int | None = None):
        self.transport, self.retries, self.clock, self.sleep = transport, retries, clock, sleep
        self.bucket, self.random = Bucket(rate, clock=clock, sleep=sleep), random.Random(seed)

    def _ask(self, path: str, attempt: int) -> tuple[int, str | None, int, int, str | None] | None:
        """The answer, or none if the request is to be tried again."""
        self.bucket.take()
        began = self.clock()
        try:
            status, body, error = *self.transport(path), None
        except OSError as e:
            status, body, error = 0, None, str(e) or type(e).__name__
        took = int((self.clock() - began) * 1000)
        if status in (401, 403):
            raise Refused(f"{status} for {path}: the key or the address isn't accepted")
        if 200 <= status < 300:
            return status, body, attempt + 1, took, None
        if status == 404:
            return status, None, attempt + 1, took, None
        return (status, None, attempt + 1, took, error or f"HTTP {status}") if attempt >= self.retries else None

    def _wait(self, attempt: int) -> float:
        return self.random.uniform(0, min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))

    def get(self, path: str) -> tuple[int, str | None, int, int, str | None]:
        """Status, body, attempts, milliseconds of the last one, and the error if none succeeded."""
        attempt = 0
        while (answer := self._ask(path, attempt)) is None:
            self.sleep(self._wait(attempt))
            attempt += 1
        return answer

    def get_all(self, paths: list[str]) -> list[tuple[int, str | None, int, int, str | None]]:
        """``get`` for each path; while a request waits to be tried again, the others are sent."""
        out, waiting = [None] * len(paths), []

        def ask(k: int, attempt: int) -> None:
            out[k] = self._ask(paths[k], attempt)
            if out[k] is None:
                heapq.heappush(waiting, (self.clock() + self._wait(attempt), k, attempt + 1))

        for k in range(len(paths)):
            while waiting and waiting[0][0] <= self.clock():
                ask(*heapq.heappop(waiting)[1:])
            ask(k, 0)
        while waiting:
            at, k, attempt = heapq.heappop(waiting)
            self.sleep(max(0.0, at - self.clock()))
            ask(k, attempt)
        return out


class Keys(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _cut(first: int, end: int, parts: int) -> list[Keys]:
    """Ranges of nearly equal size from ``first`` to before ``end``; no more than there are keys."""
    n = max(end - first, 0)
    parts = max(1, min(parts, n))
    return [Keys(first + n * k // parts, first + n * (k + 1) // parts) for k in range(parts)]


class _Ranges:
    """What both readers share: options, and the rows of a range of keys."""

    def __init__(self, options: dict, transport: Transport):
        self.transport, self.path = transport, options.get("resource", "/{key}")
        self.rate, self.parts, self.retries = float(options.get("rate", RATE)), int(options.get("parts", 8)), int(options.get("retries", RETRIES))
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 0))
        self.head = options.get("head")

    def read(self, keys: Keys) -> Iterator[tuple]:
        client = Client(self.transport, self.rate / self.parts, self.retries)
        for k in range(keys.first, keys.end):
            yield (str(k), *client.get(self.path.format(key=k)))


class Reader(_Ranges, DataSourceReader):
    def partitions(self) -> list[Keys]:
        return _cut(self.first, self.end, self.parts)


class StreamReader(_Ranges, DataSourceStreamReader):
    """Keys from the last offset to what the resource ``head`` names as the next key; ``per_trigger`` at most at a time."""

    def __init__(self, options: dict, transport: Transport):
        super().__init__(options, transport)
        self.per_trigger, self.at = int(options.get("per_trigger", 10_000)), None

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        end = self.end
        if self.head:
            status, body, *_, error = Client(self.transport, self.rate, self.retries).get(self.head)
            if error or body is None:
                raise OSError(f"{self.head}: {error or status}")
            end = int(body)
        now = self.first if self.at is None else self.at
        return {"next": max(now, min(end, now + self.per_trigger))}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        self.at = end["next"]
        return _cut(start["next"], end["next"], self.parts) if end["next"] > start["next"] else []

    def commit(self, end: dict) -> None:
        self.at = end["next"]


def register(spark: SparkSession, name: str, transport: Transport) -> None:
    """Makes ``spark.read.format(name)`` and ``readStream`` read through ``transport``.

    Options: resource (a path with {key}), first, end (keys, the end exclusive),
    rate (requests a second of all partitions together), parts, retries; for
    streams head (a path that answers with the next key) and per_trigger."""

    class Rest(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> Reader:
            return Reader(self.options, transport)

        def streamReader(self, schema: StructType) -> StreamReader:
            return StreamReader(self.options, transport)

    spark.dataSource.register(Rest)


def fetch(requests: DataFrame, transport: Transport, rate: float = RATE, parts: int = 8, retries: int = RETRIES) -> DataFrame:
    """requests: key, path.  An answer for each, by ``parts`` tasks that share the rate, each in order of its keys; for keys that are themselves a large table."""
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        client = Client(transport, rate / parts, retries)
        for batch in batches:
            rows = [(k, *answer) for k, answer in zip(batch.column("key").to_pylist(), client.get_all(batch.column("path").to_pylist()), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    dealt = requests.select("key", "path").repartition(parts).sortWithinPartitions("key")
    return dealt.selectExpr("CAST(key AS STRING) AS key", "path").mapInArrow(run, SCHEMA)
