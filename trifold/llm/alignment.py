"""Alignment of two tokenizers by inverted bitmaps of token pairs.

Both tokenizers cut the same bytes, a blank and the text.  Where tokens of both
end, a group ends; every token of one in a group is linked to every token of the
other in it.  For each pair of ids there are compressed bitmaps of documents,
one for each block of BLOCK documents: plane 0 has the documents that hold the
pair linked, and plane k + 1 those whose number of its links, less one, has bit
k.  Bitmaps of one block are merged by OR, popcounts of plane 0 give the number
of documents, and weighted popcounts of all planes the number of links.  The
postings then return the scores: each bitmap gives its documents the pair's count,
2^k times for plane k + 1.

Documents are encoded once.  Texts are cut where neither tokenizer's tokens can
reach across, so each distinct piece of a chunk is encoded and grouped once, and
a worker remembers pieces up to MEMO of them.  Bitmaps of a hot pair are spread
by block; pairs return to their postings by ``to_groups``; a block's scores are
summed in the order of blocks, one at a time.

Defined cases: null and empty texts, and those whose tokens of either side don't
spell a blank and the text, have no tokens, zeros and an empty groups_sha256; of
repeated rows each is a document of its own; ties for the highest count are all
best; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import chunks, durable, partitions, stored, table, to_groups

#: Documents of a block, bytes of its full bitmap, and pieces that a worker remembers.
BLOCK, MEMO = 1024, 900_000
FULL = BLOCK // 8
#: Up to so many pairs (24 bytes each), their counts are broadcast.
FEW_PAIRS = 1_000_000
#: A pair is the id of the first tokenizer shifted so far, and that of the second.
SHIFT = 32
#: A blank or line feed between two characters that aren't white space; letters whose comma or full stop before it stands alone.
SAFE = re.compile(r"([ \n])(?<=\S[ \n])(?=\S)")
LETTERS, STOPS = frozenset(string.ascii_lowercase), frozenset(",.")


def piece_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A sentencepiece vocabulary: the bytes of each id, and whether texts may be cut at SAFE."""

    def __init__(self, path: str):
        self.of = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.of.get_piece_size()
        names = [self.of.id_to_piece(i) for i in range(n)]
        blank = "▁"
        self.bytes = [bytes([int(x[3:5], 16)]) if self.of.is_byte(i) else x.replace(blank, " ").encode() for i, x in enumerate(names)]
        # No piece goes on with a blank after something else, none holds a line feed, and none has a stop after a letter: none reaches across a cut.
        across = lambda x: blank in x.lstrip(blank) or "\n" in x or any(a in LETTERS and b in STOPS for a, b in zip(x, x[1:]))  # noqa: B905, E731
        self.cut = not any(map(across, names)) and len(self.of.encode("\n")) == 2

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces of text; the vocabulary's own blank stands for one that a piece begins with."""
        own = [t[0] == " " for t in texts]
        # A line feed keeps the vocabulary's blank away from a piece without one; both are taken off again.
        found = self.of.encode([t[1:] if b else "\n" + t for t, b in zip(texts, own, strict=True)], num_threads=1)
        return [x if b else x[2:] for x, b in zip(found, own, strict=True)]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; none for an added token's."""
    enc = tokens.encoding(path)
    own = set(tokens.added(path)[1].values())
    return [b"" if i in own else enc.decode_single_token_bytes(i) for i in range(max([enc.max_token_value, *own]) + 1)]


def units(text: str, cut: bool = True) -> list[str]:
    """A blank and ``text``, cut where no token reaches across."""
    if not cut:
        return [" " + text]
    parts = SAFE.split(text)
    out, before = [], " "
    for k in range(0, len(parts), 2):
        part = parts[k]
        if part[-1] in STOPS and part[-2:-1] in LETTERS:
            out += [before + part[:-1], part[-1]]
        else:
            out.append(before + part)
        before = " "
        if k + 1 < len(parts) and parts[k + 1] == "\n":
            out.append("\n")
            before = ""
    return out


class Known:
    """Pieces of text seen so far, numbered: their numbers of tokens, groups and links, links as pairs, and groups as text."""

    def __init__(self, byte_path: str, piece_path: str):
        self.enc, self.piece = tokens.encoding(byte_path), pieces_of(piece_path)
        self.byte = byte_tokens(byte_path)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.byte, self.piece.bytes))
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        self.good = np.zeros(0, bool)
        self.sums = np.zeros((0, 4), np.int64)  # tokens of each side, groups, links
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in pieces if p not in self.number))
        if new:
            self.number |= zip(new, range(len(self.number), len(self.number) + len(new)))
            self._learn(new)
        return np.array(list(map(self.number.__getitem__, pieces)), np.int64)

    def _learn(self, new: list[str]) -> None:
        a, b = [self.enc.encode_ordinary(p) for p in new], self.piece.encode(new)
        spelled = [p.encode() for p in new]
        byte, piece = self.byte, self.piece.bytes
        good = [b"".join(map(byte.__getitem__, x)) == s == b"".join(map(piece.__getitem__, y)) for x, y, s in zip(a, b, spelled, strict=True)]
        sums, pairs, text = aligned([x if g else [] for x, g in zip(a, good, strict=True)], [y if g else [] for y, g in zip(b, good, strict=True)], self.size_a, self.size_b)
        self.good, self.sums = np.concatenate([self.good, good]).astype(bool), np.concatenate([self.sums, sums])
        self.pairs, self.first = np.concatenate([self.pairs, pairs]), np.concatenate([self.first, self.first[-1] + np.cumsum(sums[:, 3])])
        self.text += text


def aligned(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of texts as ids on both sides that spell the same bytes: (tokens a, tokens b, groups, links) of each, all
    links as pairs in the texts' order, and each text's groups written out."""
    n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    flat_a, flat_b = (np.fromiter((i for x in t for i in x), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b)))
    end_a, end_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
    ends = np.intersect1d(end_a, end_b)  # tokens have a byte at least, so ends differ
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    first_a, first_b = (np.searchsorted(g, np.arange(len(ends) + 1)) for g in (group_a, group_b))
    in_a, in_b = np.diff(first_a), np.diff(first_b)
    # All pairs of a group, in its order.
    each = in_b[group_a]
    left = np.repeat(flat_a, each)
    place = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    right = flat_b[np.repeat(first_b[group_a], each) + place] if len(left) else place
    text_of = np.repeat(np.arange(len(a)), n_a)[first_a[:-1]] if len(ends) else np.zeros(0, np.int64)
    n_groups = np.bincount(text_of, minlength=len(a))
    n_links = np.bincount(text_of, in_a * in_b, minlength=len(a)).astype(np.int64)
    shown_a, shown_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    fa, fb = first_a.tolist(), first_b.tolist()
    shown = [f"{','.join(shown_a[fa[g] : fa[g + 1]])}|{','.join(shown_b[fb[g] : fb[g + 1]])}" for g in range(len(ends))]
    at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    text = [";".join(shown[x:y]).encode() for x, y in zip(at, at[1:])]  # noqa: B905
    return np.stack([n_a, n_b, n_groups, n_links], axis=1), left << SHIFT | right, text


def containers(owner: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
    """``n`` compressed bitmaps: ``places`` in a block, sorted by ``owner`` and place.

    Places of two bytes each while these are shorter, FULL bytes of bits else."""
    count = np.bincount(owner, minlength=n)
    full = count * 2 >= FULL
    width = np.where(full, FULL, count * 2)
    ends = np.concatenate([[0], np.cumsum(width)])
    data = np.zeros(int(ends[-1]), np.uint8)
    few = ~full[owner]
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = ends[owner[few]] + 2 * within[few]
    data[at], data[at + 1] = places[few] & 255, places[few] >> 8
    np.bitwise_or.at(data, ends[owner[~few]] + (places[~few] >> 3), (1 << (places[~few] & 7)).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def members(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every bit that is set, sorted by both."""
    n = len(bitmaps)
    _, ends, data = bitmaps.buffers()
    ends = np.frombuffer(ends, np.int32)[bitmaps.offset : bitmaps.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and n else np.zeros(0, np.uint8)
    width = np.diff(ends)
    full = width == FULL
    count = np.where(full, 0, width // 2)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(ends[:-1], count) + 2 * within
    owner, place = np.repeat(np.arange(n), count), data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    if full.any():
        who = np.flatnonzero(full)
        bits = np.unpackbits(data[ends[who][:, None] + np.arange(FULL)], axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        owner, place = np.concatenate([owner, who[row]]), np.concatenate([place, bit])
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
    return owner, place


ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, block long, plane int, bits binary"
_ENCODED = pa.schema([(k, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in ENCODED.split(", "))])


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED], schema=_ENCODED)


def postings(row: np.ndarray, pair: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bitmaps of (row, pair, number of links), each row and pair once."""
    order = np.lexsort((row, pair, row // BLOCK))
    row, pair, links = row[order], pair[order], links[order]
    block, place = row // BLOCK, row % BLOCK
    for plane in range(1 + int(links.max() - 1).bit_length() if len(links) else 0):
        has = np.ones(len(row), bool) if plane == 0 else ((links - 1) >> (plane - 1) & 1).astype(bool)
        b, p = block[has], pair[has]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (p[1:] != p[:-1])
        at = np.flatnonzero(new)
        yield _batch(len(at), pair=p[at], block=b[at], plane=np.full(len(at), plane, np.int32), bits=containers(np.cumsum(new) - 1, place[has], len(at)))


def _encode(byte_path: str, piece_path: str):
    def run(batches):
        known = Known(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, "text"):
            if len(known.number) > MEMO:
                known = Known(byte_path, piece_path)
            n = batch.num_rows
            cut = [units(t, known.piece.cut) if t else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in cut], np.int64)
            number = known.numbers([p for x in cut for p in x])
            doc = np.repeat(np.arange(n), sizes)
            # A text with a piece that isn't spelled has no tokens: cuts are at blanks and line feeds, which either side keeps.
            bad = np.bincount(doc, ~known.good[number], minlength=n) > 0
            keep = ~bad[doc]
            doc, number = doc[keep], number[keep]
            sums = np.stack([np.bincount(doc, known.sums[number, k], minlength=n) for k in range(4)], axis=1).astype(np.int64) if n else np.zeros((0, 4), np.int64)
            first = np.searchsorted(doc, np.arange(n + 1)).tolist()
            listed, text = number.tolist(), known.text
            sha = [hashlib.sha256(b";".join([text[k] for k in listed[x:y]])).hexdigest() if y > x else "" for x, y in zip(first, first[1:])]  # noqa: B905
            rows = row + np.arange(n)
            yield _batch(n, row=rows, doc_id=batch.column("doc_id").cast(pa.int64()), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups_sha256=sha)
            # Each piece of a text once, with how often it stands there; then its pairs.
            both, times = np.unique(doc * len(text) + number, return_counts=True)
            if len(both):
                d, k = both // len(text), both % len(text)
                each = known.sums[k, 3]
                within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                pair = known.pairs[np.repeat(known.first[k], each) + within]
                d, links = np.repeat(d, each), np.repeat(times, each)
                order = np.lexsort((d, pair))
                d, pair, links = d[order], pair[order], links[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (pair[1:] != pair[:-1])
                at = np.flatnonzero(new)
                yield from postings(rows[d[at]], pair[at], np.add.reduceat(links, at))
            row += n

    return run


MERGED = "pair long, block long, plane int, bits binary, n long"


def _merge(batches):
    """Rows sorted by pair, block and plane; equal ones are merged by OR, n is the number of bits."""
    held, names = None, ["pair", "block", "plane", "bits"]

    def out(t: pa.RecordBatch):
        keys = [t.column(c).to_numpy() for c in ("pair", "block", "plane")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        at, of = np.flatnonzero(new), np.cumsum(new) - 1
        owner, place = members(t.column("bits"))
        both = np.unique(of[owner] * BLOCK + place)
        bits, n = containers(both // BLOCK, both % BLOCK, len(at)), np.bincount(both // BLOCK, minlength=len(at))
        return pa.RecordBatch.from_arrays([*[pa.array(k[at]) for k in keys], bits, pa.array(n.astype(np.int64))], names=["pair", "block", "plane", "bits", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(c), batch.column(c)]) for c in names], names=names)
        keys = [batch.column(c).to_numpy() for c in ("pair", "block", "plane")]
        same = np.all([k == k[-1] for k in keys], axis=0)
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            yield out(batch.slice(0, last))
        held = batch.slice(last)
        if held.num_rows > 1:  # a block's bitmaps of one pair and plane become one at once
            held = out(held).select(names)
    if held is not None and held.num_rows:
        yield out(held)


def _returned(batches):
    """Rows sorted by block, with their pair's count and whether it is best: n_best and count_sum of each document."""
    now, sums = None, None

    def out():
        at = np.flatnonzero(sums[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(now * BLOCK + at), pa.array(sums[at, 0]), pa.array(sums[at, 1])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        weight = np.left_shift(1, np.maximum(batch.column("plane").to_numpy().astype(np.int64) - 1, 0))
        total = weight * batch.column("count").to_numpy()
        best = weight * batch.column("best").to_numpy()
        owner, place = members(batch.column("bits"))
        edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for x, y in zip(edge, edge[1:]):  # noqa: B905
            if block[x] != now:
                if now is not None:
                    yield out()
                now, sums = int(block[x]), np.zeros((BLOCK, 2), np.int64)
            i, j = np.searchsorted(owner, [x, y])
            np.add.at(sums[:, 0], place[i:j], best[owner[i:j]])
            np.add.at(sums[:, 1], place[i:j], total[owner[i:j]])
    if now is not None:
        yield out()


class Index:
    """Bitmaps of all pairs of ``docs``: ``docs`` has a row for each document, ``planes`` the merged bitmaps."""

    def __init__(self, docs: DataFrame, byte_path: str | None = None, piece_model: str | None = None):
        paths = byte_path or tokens.default_path(), piece_model or piece_path()
        self.encoded = stored(docs.select("doc_id", "text").mapInArrow(_encode(*paths), ENCODED))
        self.docs = self.encoded.where("row IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        rows = self.encoded.where("pair IS NOT NULL").select("pair", "block", "plane", "bits")
        rows = rows.repartition(partitions(docs.sparkSession), "pair", "block").sortWithinPartitions("pair", "block", "plane")
        self.planes = stored(rows.mapInArrow(_merge, MERGED))

    def counts(self) -> DataFrame:
        """pair, a, b, count (documents that hold it linked), links, best (whether its count is the highest of its a) and rows (bitmaps)."""
        on = F.col("plane") == 0
        weight = F.when(on, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("plane") - 1))
        by = self.planes.groupBy("pair").agg(F.sum(F.when(on, F.col("n"))).alias("count"), F.sum(F.col("n") * weight).alias("links"), F.count(F.lit(1)).alias("rows"))
        by = durable(by.withColumns({"a": F.shiftright("pair", SHIFT).cast("int"), "b": F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")}))
        most = by.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
        return by.join(F.broadcast(most), "a").withColumn("best", F.col("count") == F.col("most")).drop("most")

    def scores(self) -> DataFrame:
        """row, n_best and count_sum of the documents with tokens."""
        counts = durable(self.counts().select("pair", "count", F.col("best").cast("long").alias("best"), "rows"))
        rows = self.planes.select("pair", "block", "plane", "bits")
        if counts.count() <= FEW_PAIRS:
            rows = rows.join(F.broadcast(counts.drop("rows")), "pair")
        else:
            rows = to_groups(rows, counts, "pair", "rows", self.planes.count()).drop("rows")
        rows = rows.select("block", "plane", "bits", "count", "best").repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block")
        return rows.mapInArrow(_returned, "row long, n_best long, count_sum long")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = index.docs.join(index.scores(), "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
