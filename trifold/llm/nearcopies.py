"""Near copies: documents whose sets of word shingles have a Jaccard similarity of SIMILARITY or more.

The deletion-variant signatures of ``simhash``, on fingerprints wide enough for
that similarity.  Shingles are SHINGLE words, A-Z lower-cased.

1. A text's fingerprint has SEGMENTS x WIDE bits; bit i is 1 if it is set in over
   half of the hashes of its shingles.  Texts with equal sets of shingles are one
   node from here on.  Two sets of similarity 0.8 differ in 15 % of the bits on
   average, so a segment of 28 bits often differs by one bit or two, and mostly
   in those bits where a text's count is nearest to half.
2. Each segment is indexed as it is and once for each of its LOOSE least certain
   bits with that bit as a wildcard.  Nodes with an equal key meet in one run of a
   sorted partition, where NEAR64 of 64 bits keep chance meetings out.
3. What is left, a small part, gets its whole fingerprint and meets by the same
   keys once more.  A run gives a forest of links that joins whatever is within
   LIMITS, close pairs first, so links are linear in the run.
4. Each link is verified by the exact similarity of the two sets.

Classes are the components of the verified links.  The fingerprint only finds
candidates: at a similarity of exactly 0.8 about one pair in a hundred shares no
key, at 0.85 one in a thousand; what is found is exact up to 64-bit hashes.

Defined cases: null and empty texts are alike; a text of fewer words than a
shingle has one; decisions are made by row, so of repeated rows one stays; of a
class the smallest doc_id stays, a null one last; an empty table gives no rows;
other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, by_rows, chunks, durable, gram_hashes, hash_words, mix, numbered, partitions, utf8, word_spans
from .simhash import components

SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS, WIDE, LOOSE = 32, 28, 5
LONGS = SEGMENTS * WIDE // 64
NEAR64 = 18
#: Differing bits at similarity 0.85, and at 0.8 with two standard deviations.
LIMITS = (116, 157)
#: Runs longer than this are passed on whole in step 2; nodes that a task makes keys of at once.
LONG, AT_ONCE = 1024, 2000
_SALT = mix(np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offs = utf8(texts)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offs)
    words = hash_words(raw, starts, ends)
    grams = gram_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):  # noqa: B905
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if b - a >= SHINGLE else gram_hashes(words[a:b], max(b - a, 1)))
    return out


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def fingerprint(shingles: np.ndarray) -> tuple[bytes, bytes]:
    """The bits, and which of them are the least certain of their segment."""
    count = np.zeros(SEGMENTS * WIDE, np.int64)
    for a in range(0, len(shingles), 255):  # so that counts fit into a byte
        hashes = mix(shingles[a : a + 255, None] ^ _SALT)
        count += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = np.abs(2 * count - len(shingles)).reshape(SEGMENTS, WIDE)
    loose = np.zeros((SEGMENTS, WIDE), bool)
    np.put_along_axis(loose, margin.argsort(axis=1, kind="stable")[:, :LOOSE], True, axis=1)
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return pack(2 * count > len(shingles)), pack(loose.ravel())


def _sketch(batches):
    for batch in chunks(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        prints = [fingerprint(s) for s in sets]
        columns = [pa.array([node_of(s) for s in sets], pa.int64()), *(pa.array([p[k] for p in prints], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id").cast(pa.int64()), *columns], names=[ROW, "doc_id", "node", "print", "loose"])


def sketches(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, node, print and loose of numbered documents."""
    docs = docs.select(ROW, "doc_id", "text")
    return docs.mapInArrow(_sketch, f"{ROW} {docs.schema[ROW].dataType.simpleString()}, doc_id long, node long, print binary, loose binary")


def _bits(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(raw, axis=1, bitorder="little").reshape(len(column), SEGMENTS, WIDE)


def keys_of(prints: pa.Array, loose: pa.Array) -> np.ndarray:
    """Of each node the segments' numbers, then their bits, one row with each wildcard bit turned."""
    n, power = len(prints), np.int64(1) << np.arange(WIDE, dtype=np.int64)
    value = _bits(prints) @ power + (np.arange(SEGMENTS) << WIDE)
    turn = power[np.nonzero(_bits(loose))[2].reshape(n, SEGMENTS, LOOSE)]
    return np.concatenate([value[:, :, None], value[:, :, None] ^ turn], axis=2).reshape(n, -1)


def _keys(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            keys = keys_of(batch.column("print"), batch.column("loose"))
            node, first = (np.repeat(x, keys.shape[1]) for x in (batch.column("node").to_numpy(), np.array([p[:8] for p in batch.column("print").to_pylist()]).view("<i8")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array(first)], names=["key", "node", "first"])


def _runs(batches, columns):
    """Sorted rows as lists of numpy columns, each holding whole keys; a key may span batches."""
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last:
            yield [x[:last] for x in now]
        rest = [x[last:].copy() for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def _edges_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return start, np.append(start[1:], len(key))


def _met(batches):
    """(key, node) of the nodes that have another one nearby in their run."""
    for key, node, first in _runs(batches, ["key", "node", "first"]):
        first = first.view(np.uint64)
        start, end = _edges_of(key)
        keep = np.zeros(len(key), bool)
        two = start[end - start == 2]
        near = two[(np.bitwise_count(first[two] ^ first[two + 1]) <= NEAR64) & (node[two] != node[two + 1])]
        keep[near] = keep[near + 1] = True
        for i, j in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
            if j - i > LONG:
                keep[i:j] = True
                continue
            other = (np.bitwise_count(first[i:j, None] ^ first[None, i:j]) <= NEAR64) & (node[i:j, None] != node[None, i:j])
            keep[i:j] = other.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])


def forest(prints: np.ndarray, limits: tuple[int, ...] = LIMITS) -> list[tuple[int, int]]:
    """Links that join what is within the last limit, by rows of ``prints``; those within the first one come first."""
    out, label = [], np.arange(len(prints))
    for limit in limits:
        new, left = label.copy(), np.arange(len(prints))
        while len(left) > 1:
            root, front, left = left[0], [left[0]], left[1:]
            new[root] = root
            while front and len(left):
                u = front.pop()
                near = np.bitwise_count(prints[left] ^ prints[u]).sum(axis=1) <= limit
                hit, left = left[near], left[~near]
                new[hit] = root
                out += [(int(u), v) for v in hit[label[hit] != label[u]].tolist()]
                front += hit.tolist()
        label = new
    return out


def _links(batches):
    """Sorted (key, node, print) rows to links (a, b)."""
    for key, node, prints in _runs(batches, ["key", "node", "print"]):
        start, end = _edges_of(key)
        wide = np.frombuffer(b"".join(prints), "<u8").reshape(-1, LONGS)
        found = []
        for i, j in zip(start.tolist(), end.tolist(), strict=True):
            _, own = np.unique(node[i:j], return_index=True)
            found += [(node[own[u] + i], node[own[v] + i]) for u, v in forest(wide[i + own])]
        pairs = np.unique(np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes to verify."""
    parts = partitions(nodes.sparkSession)
    keys = nodes.select("node", "print", "loose").mapInArrow(_keys, "key long, node long, first long")
    met = keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_met, "key long, node long")
    met = durable(met).join(nodes.select("node", "print"), "node").repartition(parts, "key").sortWithinPartitions("key")
    return met.select("key", "node", "print").mapInArrow(_links, "a long, b long").distinct()


def _sets(batches):
    for batch in chunks(batches, "text"):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])


def verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose sets of shingles are similar enough, with the similarity as j."""
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text for each linked node.
    texts = by_rows(docs.select(ROW, "text"), nodes.join(linked, "node", "left_semi").select(F.col(f"best.{ROW}").alias(ROW)), "left_semi")
    sets = durable(texts.select("text").mapInArrow(_sets, "node long, shingles array<long>"))
    pairs = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("j")).where(F.col("j") >= similarity)


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, print, loose and best, the row that stays if no link says otherwise."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("best")
    out = rows.groupBy("node").agg(F.first("print").alias("print"), F.first("loose").alias("loose"), best)
    return out.repartition(partitions(rows.sparkSession), "node")


def drop_near_copies(docs: DataFrame, as_read: bool = False) -> DataFrame:
    """The document with the smallest doc_id of each class, with all its columns; ``as_read`` is that of ``numbered``."""
    docs = numbered(docs, as_read)
    rows = durable(sketches(docs))
    nodes = durable(nodes_of(rows))
    root = components(verified(docs, nodes, durable(candidates(nodes))))
    kept = nodes.join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    gone = rows.select(ROW).join(kept.select(F.col(f"best.{ROW}").alias(ROW)), ROW, "left_anti")
    return by_rows(docs, gone, "left_anti").drop(ROW)
