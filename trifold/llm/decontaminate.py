"""Benchmark decontamination by winnowing.

Of every window of WINDOW consecutive words, the smallest hash of its GRAM-word
runs is a fingerprint.  Equal windows choose equal fingerprints, so each shared
span of WINDOW words or more has one in common.  The fingerprints of the
benchmark and of the documents are joined, and each joint one is extended word
by word to the left and right; a shared stretch of WINDOW words is a hit.  An
item shorter than a window is one window of its own, looked up by its hash.

The benchmark reaches the executors in blocks of at most BLOCK_BYTES of text,
each against all documents, so nothing that grows without bound is broadcast.
Equal rows of the benchmark go once.  With several blocks the documents are
stored with a number for each row, by which the blocks' results are merged.

Defined cases: a null text has no words; an item or document without words has
no window; a null item_id counts as the empty name; rows that repeat an item_id
are one item; documents that repeat a doc_id, null or not, are rows of their
own and give one each; equal items under two names count twice; an empty benchmark hits
nothing; an empty corpus gives no rows.  Documents keep their other columns out
of the way, whatever those are called.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, chunks, durable, gram_hashes, hash_words, lookup, stored, table, utf8, window_minima, word_spans

WINDOW, GRAM = 10, 4
BLOCK_BYTES = 32 << 20
#: Digits, lower-case letters and everything beyond ASCII.
IS_WORD = ~lookup(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

HITS = "doc_id long, row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_HITS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text (one more for the end)."""
    raw, offs = utf8(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offs, IS_WORD)
    return hash_words(raw, starts, ends), first


def fingerprints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed grams; no window spans two texts."""
    grams = gram_hashes(words, GRAM)
    picked = window_minima(grams, WINDOW - GRAM + 1)
    inside = np.zeros(len(picked), bool)
    if len(picked):
        mark = np.zeros(len(words) + 1, np.int32)
        last = np.maximum(first[1:] - WINDOW + 1, first[:-1])
        np.add.at(mark, first[:-1], 1)
        np.add.at(mark, last, -1)
        inside = np.cumsum(mark)[: len(picked)] > 0
    at = np.unique(picked[inside])
    return at, grams[at] if len(at) else np.zeros(0, np.uint64)


class Items:
    """One block of the benchmark: words, fingerprints and short items, as sorted arrays."""

    def __init__(self, names: list[str], texts: list[str]):
        self.names = np.array(names, dtype=object)
        self.words, self.first = words_of(pa.array(texts, pa.string()))
        at, prints = fingerprints(self.words, self.first)
        order = np.argsort(prints, kind="stable")
        self.prints, self.at = prints[order], at[order]
        size = np.diff(self.first)
        self.short = {}
        for n in sorted({int(x) for x in size if 0 < x < WINDOW}):
            who = np.flatnonzero(size == n)
            key = gram_hashes(self.words, n)[self.first[who]]
            order = np.argsort(key, kind="stable")
            self.short[n] = key[order], who[order]

    @staticmethod
    def _pairs(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equality join: positions in ``asked`` and in ``sorted_keys``."""
        lo, hi = np.searchsorted(sorted_keys, asked, "left"), np.searchsorted(sorted_keys, asked, "right")
        n = hi - lo
        left = np.repeat(np.arange(len(asked)), n)
        return left, np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(left)) if len(n) else left

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the shared stretches among ``words``, and the item of each."""
        found = []
        at, prints = fingerprints(words, first)
        left, right = self._pairs(self.prints, prints)
        if len(left):
            p, q = at[left], self.at[right]
            d = np.searchsorted(first, p, "right") - 1
            item = np.searchsorted(self.first, q, "right") - 1
            same = np.ones(len(p), bool)
            for j in range(GRAM):
                same &= words[p + j] == self.words[q + j]
            p, q, d, item = p[same], q[same], d[same], item[same]
            ahead = self._extent(words, p, q, -1, p - first[d], q - self.first[item])
            after = self._extent(words, p + GRAM - 1, q + GRAM - 1, 1, first[d + 1] - p - GRAM, self.first[item + 1] - q - GRAM)
            ok = ahead + GRAM + after >= WINDOW
            found.append((p[ok] - ahead[ok], p[ok] + GRAM + after[ok], item[ok]))
        for n, (key, who) in self.short.items():
            grams = gram_hashes(words, n)
            start = np.flatnonzero(np.isin(grams, key))
            start = start[start + n <= first[np.searchsorted(first, start, "right")]] if len(start) else start
            left, right = self._pairs(key, grams[start])
            found.append((start[left], start[left] + n, who[right]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip((none, none, none), *found, strict=True))

    def _extent(self, words, p, q, step, room_p, room_q):
        """How many words from p and q on are equal, WINDOW - GRAM at most: what lies farther has a fingerprint of its own."""
        n = np.zeros(len(p), np.int64)
        on = np.ones(len(p), bool)
        for j in range(1, WINDOW - GRAM + 1):
            on &= (room_p >= j) & (room_q >= j)
            i = np.flatnonzero(on)
            on[i] = words[p[i] + step * j] == self.words[q[i] + step * j]
            n += on
        return n


def _hits(block):
    def run(batches):
        items = block.value
        for batch in chunks(batches, "text"):
            words, first = words_of(batch.column("text"))
            start, end, item = items.hits(words, first)
            cover = np.zeros(len(words) + 1, np.int32)
            np.add.at(cover, start, 1)
            np.add.at(cover, end, -1)
            hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            a, b = edge[::2], edge[1::2]
            # A stretch that touches the next text's is cut at the border.
            cut = np.setdiff1d(first[:-1][np.diff(first) > 0], a)
            inner = cut[hit[1:][cut] & hit[:-1][cut]] if len(cut) else cut
            a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
            doc = np.searchsorted(first, a, "right") - 1
            spans, names = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for d, i, j in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True):
                spans[d].append({"start": i - int(first[d]), "end": j - int(first[d])})
            if len(start):
                of = np.searchsorted(first, start, "right") - 1
                for d, i in np.unique(np.stack([of, item]), axis=1).T.tolist():
                    names[d].add(items.names[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row"), pa.array(np.diff(first), pa.int64()), pa.array(spans, _HITS.field("spans").type), pa.array([sorted(x) for x in names], _HITS.field("items").type)], schema=_HITS)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], Broadcast]]:
    """How many blocks the benchmark's distinct rows take, and what broadcasts one of them."""
    spark = benchmark.sparkSession
    items = durable(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("name")), F.lit(0))).first()[0]
    n = -(-int(size) * 2 // block_bytes) if size > block_bytes else 1

    def block(b: int) -> Broadcast:
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == b)
        rows = own.collect()  # of a block, whose size is bounded
        return spark.sparkContext.broadcast(Items([r.name for r in rows], [r.text for r in rows]))

    return n, block


def find_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (of words, end exclusive; of several blocks, they may overlap) and items."""
    n, block = _blocks(benchmark, block_bytes)
    docs, out = docs.select("doc_id", "text", F.lit(0).cast("long").alias("row")), None
    if n > 1:
        docs = stored(docs.withColumn("row", F.monotonically_increasing_id()))
    for b in range(n):
        part = docs.mapInArrow(_hits(block(b)), HITS)
        out = part if out is None else out.unionAll(part)
    if n == 1:
        return out.drop("row")
    return out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("row")


def n_covered(spans):
    """Words under sorted spans, those under several counted once."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["to"], x["start"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(docs, benchmark).withColumn("n_hit", n_covered("spans"))
    names = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(block):
    def run(batches):
        items = block.value
        for batch in chunks(batches, "text"):
            words, first = words_of(batch.column("text"))
            start, _, _ = items.hits(words, first)
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(first, start, "right") - 1] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a hit, with all their columns, a null text as it was.

    Each batch of documents is decided where it is read, so no text is shuffled;
    what one block of the benchmark leaves is stored before the next one comes."""
    n, block = _blocks(benchmark, block_bytes)
    names = docs.columns
    out = docs.toDF(*[x if x == "text" else f"c{k}" for k, x in enumerate(names)]).withColumn("void", F.col("text").isNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for b in range(n):
        out = (stored(out) if b else out).mapInArrow(_clean(block(b)), schema)
    return out.withColumn("text", F.when(~F.col("void"), F.col("text"))).drop("void").toDF(*names)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT name, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, name FROM dw JOIN bw USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) AS t(j) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS h FROM (SELECT DISTINCT doc_id, name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN names USING (doc_id)""",
}
