"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of BITS bits is cut into SEGMENTS segments, fewer than a plain
pigeonhole cut for DISTANCE needs, so that of two fingerprints within DISTANCE
bits one segment differs by at most one bit.  Each segment is indexed once for
every bit of it, with that bit as a wildcard; fingerprints whose segment
differs by one bit at most share one such variant.  Equal variants meet in one
run of a sorted partition, where the whole fingerprints are compared.

Only distinct fingerprints are indexed.  Each run yields links to the smallest
fingerprint of its local component, so links stay linear in the run.  A long
run is compared in blocks, after a further cut of the other bits into
DISTANCE + 1 pieces, one of which linked fingerprints share.

Links form classes by repeated star contraction in Spark; nothing of them comes
to the driver but counts.  Near copies by similarity, with wider fingerprints,
are in ``nearcopies``.

Defined cases: null and empty texts have no words and fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; repeated rows share
a fingerprint and thus a class; a null doc_id names a class only if no other
is in it; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, durable, partitions, table, to_groups, utf8

BITS, DISTANCE, SEGMENTS, SHINGLE, SEED = 64, 2, 2, 3, 42
WIDE = BITS // SEGMENTS
#: Runs up to this many fingerprints are compared at once.
BLOCK = 1024
#: Links up to this number (16 bytes each) are put together by one task.
FEW_LINKS = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text: bit i is set if over half of the shingles' XXH64 have it."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a + 1 : b], SEED) for a, b in zip(ends, ends[shingle:])]  # noqa: B905
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def _prints(shingle):
    def run(batches):
        for batch in chunks(batches, "text"):
            raw, offs = utf8(batch.column("text"))
            raw, offs = raw.tobytes(), offs.tolist()
            prints = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs, offs[1:])], np.uint64)  # noqa: B905
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and print, the fingerprint's 64 bits as a long."""
    return docs.select("doc_id", "text").mapInArrow(_prints(shingle), "doc_id long, print long")


def variants(prints: DataFrame) -> DataFrame:
    """One row per fingerprint, segment and wildcard bit; key holds what has to be equal."""
    x = F.col("print")
    keys = []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned(x, s * WIDE).bitwiseAND(F.lit((1 << WIDE) - 1))
        for bit in range(WIDE):
            rest = segment.bitwiseAND(F.lit(((1 << WIDE) - 1) ^ (1 << bit)))
            # The wildcard bit is out, so the rest fits below the segment's and bit's number.
            squeezed = rest.bitwiseAND(F.lit((1 << bit) - 1)).bitwiseOR(F.shiftrightunsigned(rest, bit + 1) * F.lit(1 << bit))
            keys.append(squeezed + F.lit((s * WIDE + bit) << (WIDE - 1)))
    return prints.repartition(partitions(prints.sparkSession)).select("print", F.explode(F.array(*keys)).alias("key"))


def local_links(prints: np.ndarray, cut: bool = True) -> np.ndarray:
    """Rows (a, b) that link every fingerprint to the smallest of its component under the distance."""
    if cut and len(prints) > BLOCK:
        width, parts, bits = -(-BITS // (DISTANCE + 1)), [], np.uint64
        for k in range(DISTANCE + 1):
            piece = (prints >> bits(k * width)) & bits((1 << width) - 1)
            order = np.argsort(piece, kind="stable")
            edges = np.flatnonzero(np.diff(piece[order])) + 1
            parts += [local_links(x, cut=False) for x in np.split(prints[order], edges) if len(x) > 1]
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    found = []
    for i in range(0, len(prints), BLOCK):
        for j in range(i, len(prints), BLOCK):
            a, b = np.nonzero(np.bitwise_count(prints[i : i + BLOCK, None] ^ prints[None, j : j + BLOCK]) <= DISTANCE)
            keep = a + i < b + j
            found.append(np.stack([a[keep] + i, b[keep] + j], axis=1))
    pairs = np.concatenate(found)
    if not len(pairs):
        return np.zeros((0, 2), np.uint64)
    label = prints.copy()
    while True:  # the smallest label spreads along the links
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        if (new == label).all():
            break
        label = new
    moved = label != prints
    return np.stack([prints[moved], label[moved]], axis=1)


def _runs(batches):
    """Sorted (key, print) rows to links (a, b); a run may span batches."""
    key, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key, prints):
        edge = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = end - start
        two = start[size == 2]
        a, b = prints[two], prints[two + 1]
        near = np.bitwise_count(a ^ b) <= DISTANCE
        parts = [np.stack([np.maximum(a, b)[near], np.minimum(a, b)[near]], axis=1)]
        for i, j in zip(start[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            at = int(key[i]) >> (WIDE - 1)
            bit = (prints[i:j] >> np.uint64(at)) & np.uint64(1)
            # Fingerprints that agree in the wildcard bit too meet under every bit; the first one is enough.
            if at % WIDE == 0 or bit.min() != bit.max():
                parts.append(local_links(prints[i:j]))
        out = np.unique(np.concatenate(parts), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield links(key[:last], prints[:last])
            key, prints = key[last:].copy(), prints[last:].copy()
    if len(key):
        yield links(key, prints)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints that join whatever is within the distance."""
    rows = variants(prints).repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key")
    return rows.select("key", "print").mapInArrow(_runs, "a long, b long").distinct()


def _star(batches):
    """All links of one task to (a, smallest node of its component)."""
    parts = [np.stack([b.column(c).to_numpy() for c in ("a", "b")], axis=1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, pairs = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = pairs.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:  # the smallest label spreads along the links and along labels' labels
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Of links (a, b): node and root, the component's smallest node, for every linked node but the roots.

    Stars are drawn together by turns: each node's larger neighbours go to its
    smallest one, then each node's smaller neighbours do.  A node of very many
    links is handled like any hot key.  Once there are FEW_LINKS or fewer, one
    task finishes them."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    was = state(edges)
    while was[0] > FEW_LINKS:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select("a", F.least("a", "m").alias("m"), "n")
        large = durable(to_groups(both, low, "a", "n", 2 * was[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = least(large)
        small = to_groups(large, low, "a", "n", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        edges = durable(edges.coalesce(1).mapInArrow(_star, "a long, b long"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, print and component_id, the smallest doc_id that links reach."""
    rows = durable(fingerprints(docs, shingle))
    nodes = durable(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    root = components(links(nodes.select("print")))
    of = nodes.join(root, nodes["print"] == root["node"], "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    low = of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("k"))
    of = to_groups(of, low, "root", "k", nodes.count()).select("print", "n", "component_id")
    return to_groups(rows, durable(of), "print", "n", rows.count()).select("doc_id", "print", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
