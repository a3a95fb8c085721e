"""Substring deduplication with FM-index shards.

A window is WINDOW consecutive words.  The words of a document that lie in a
window which also starts in a document with a smaller doc_id are removed.

1. Every window names one of its GRAM-word runs, the one with the smallest
   hash.  Equal windows name equal runs, so a window can only be repeated if its
   run is named in two documents.  Tasks send the distinct hashes of their
   documents, by buckets of documents, and get back which of them are shared.
2. The windows that name the same shared run at the same place form a piece of
   text.  Pieces go to the shard of their run's hash; equal pieces of a bucket
   go once, for the smallest of their documents.  Runs that over HOT documents
   name are cut into single windows, which go by their own hash instead, with
   the smallest document of the bucket and no list of the others.
3. Each shard indexes its pieces in a compressed FM-index over words, with the
   smallest document of each suffix range, and streams the pieces through it:
   backward search over the wavelet matrix gives matching statistics, and
   windows with a full match in a smaller document are reported as intervals.
   Of a single window the two smallest documents are indexed; the buckets of
   further copies hear at once which document has it first, so a window that
   stands in every bucket streams through its shard and is never held there.
4. The intervals return to their texts, which drop the words under them.  Single
   windows return as (hash, first document) and are found again in the bucket.

Documents are compared by doc_id; places name a text.  Equal rows share a
bucket, and where a bucket has different texts under one doc_id those are
numbered in order.  A place is that number and the word's position in one long.

A shard takes runs up to about SYMBOLS words at a time, a bucket about
BUCKET_BYTES of text, so memory is bounded whatever the corpus, and exchanges
have MOST_PARTS partitions at most.  Texts are shuffled once; the exchange serves steps 2 and 4.

Defined cases: a null text has no words, nor has an empty one; a document of
fewer words than a window loses none; a null doc_id counts as larger than all
others, as large as the largest long; rows that repeat a doc_id, null or not, don't remove anything from each
other, whatever their texts are, and each loses its own windows only; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, hash_words, mix, partitions, runs, table, utf8, window_minima, word_spans
from .fmindex import FMIndex

WINDOW, GRAM = 13, 3
HOT, SYMBOLS, BUCKET_BYTES = 2000, 300_000, 16 << 20
#: An exchange has at most MOST_PARTS partitions, each of which holds several buckets in order beyond that.
MOST_PARTS = 20_000
#: How many hashes a task of step 1 collects before it sends them.
SENT_KEYS = 1 << 19
LAST_ID = (1 << 63) - 1
#: A place's lower bits are the word's position.
PLACE = 32


def _words(texts: pa.Array):
    raw, offs = utf8(texts)
    starts, ends, first = word_spans(raw, offs)
    return raw, starts, ends, first, hash_words(raw, starts, ends)


def _named(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text, the place of the run that each names, and all runs' hashes."""
    grams = gram_hashes(words, GRAM)
    names = window_minima(grams, WINDOW - GRAM + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.flatnonzero(text[: len(names)] == text[WINDOW - 1 : WINDOW - 1 + len(names)]) if len(names) else names
    return window, names[window] if len(names) else names, grams


# Step 1: which runs are named in two documents or more


def _named_by(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs that a batch's windows name, by bucket, and how many documents name each (255 at most)."""
    _, _, _, first, words = _words(batch.column("text"))
    _, names, grams = _named(words, first)
    at = np.unique(names)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    doc = np.searchsorted(first, at, "right") - 1
    ids, buckets = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc], batch.column("bucket").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
    keys = grams[at]
    order = np.lexsort((ids, keys, buckets))
    keys, ids, buckets = keys[order], ids[order], buckets[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1]))
    other = np.append(True, new[1:] | (ids[1:] != ids[:-1]))  # another document
    group = np.flatnonzero(new)
    return keys[group], buckets[group], np.minimum(np.add.reduceat(other.astype(np.int64), group), 255).astype(np.uint8)


def _packed(named: list, parts: int) -> pa.RecordBatch:
    """A row for each partition that hashes go to; those of a bucket follow each other."""
    keys, buckets, n = (np.concatenate(x) for x in zip(*named, strict=True))
    place = ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((buckets, place))
    keys, buckets, place, n = keys[order], buckets[order], place[order], n[order]
    edge = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    offs = pa.array(np.append(edge, len(keys)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offs, x) for x in (pa.array(keys.view(np.int64)), pa.array(buckets.astype(np.int32)), pa.array(n.astype(np.int16)))]
    return pa.RecordBatch.from_arrays([pa.array(place[edge]), *lists], names=["place", "keys", "buckets", "n"])


def _send(parts):
    def run(batches):
        named, held = [], 0
        for batch in chunks(batches, "text", 1 << 22):
            named.append(_named_by(batch))
            held += len(named[-1][0])
            if held >= SENT_KEYS:
                yield _packed(named, parts)
                named, held = [], 0
        if held:
            yield _packed(named, parts)

    return run


SENT = "place long, keys array<long>, buckets array<int>, n array<short>"


def _answers(told: list) -> pa.RecordBatch:
    """A row for each bucket: its keys, and whether each is hot."""
    keys, bucket, hot = (np.concatenate(x) for x in zip(*told, strict=True))
    order = np.argsort(bucket, kind="stable")
    keys, bucket, hot = keys[order], bucket[order], hot[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    to = np.append(start[1:], len(keys))
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(start, to, strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), cut(keys), cut(hot)], names=["bucket", "keys", "hot"])


def _shared(batches):
    """Rows in order of their keys to the keys that two documents or more name, by bucket."""
    told, held = [], 0
    for key, bucket, n in runs(batches, ["key", "bucket", "n"]):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.repeat(np.add.reduceat(n.astype(np.int64), start), np.diff(np.append(start, len(key))))
        more = total > 1
        told.append((key[more], bucket[more], total[more] > HOT))
        held += int(more.sum())
        if held >= SENT_KEYS:
            yield _answers(told)
            told, held = [], 0
    if held:
        yield _answers(told)


# Step 2: the pieces of a bucket

#: single: 0 is a piece with all its ids and places; 1 and 2 are single windows of one and of several documents of the bucket.
PIECES = "key long, bucket long, single tinyint, text string, own long, ids array<long>, places array<long>"
_PIECES = pa.schema([("key", pa.int64()), ("bucket", pa.int64()), ("single", pa.int8()), ("text", pa.string()), ("own", pa.int64()), ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def _slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string column of byte ranges."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))


def _numbered(docs: pa.Table) -> pa.Table:
    """A bucket's documents with ``number``: which of the distinct texts under its doc_id a row has, in order."""
    ids = docs.column("doc_id").to_numpy()
    _, which, n = np.unique(ids, return_inverse=True, return_counts=True)
    number = np.zeros(len(ids), np.int64)
    again = np.flatnonzero(n[which] > 1)
    if len(again):
        rows = list(zip(ids[again].tolist(), docs.column("text").take(pa.array(again)).to_pylist(), strict=True))
        at: dict[int, int] = {}
        of = {}
        for doc_id, text in sorted(set(rows)):
            of[doc_id, text] = at[doc_id] = at.get(doc_id, -1) + 1
        number[again] = [of[row] for row in rows]
    return docs.append_column("number", pa.array(number))


def _pieces(docs: pa.Table, answer: pa.Table) -> pa.Table:
    none = _PIECES.empty_table()
    if not docs.num_rows or not answer.num_rows:
        return none
    shared = np.concatenate([np.frombuffer(x, np.uint64) for x in answer.column("keys").to_pylist()])
    hot = np.concatenate([np.frombuffer(x, bool) for x in answer.column("hot").to_pylist()])
    hot, shared = np.unique(shared[hot]), np.unique(shared)
    out = [none]
    for batch in chunks(_numbered(docs).select(["doc_id", "text", "bucket", "number"]).to_batches(), "text", BUCKET_BYTES):
        raw, starts, ends, first, words = _words(batch.column("text"))
        window, names, grams = _named(words, first)
        keep = np.isin(grams[names], shared) if len(names) else np.zeros(0, bool)
        window, names = window[keep], names[keep]
        if not len(window):
            continue
        full = gram_hashes(words, WINDOW)
        single = np.isin(grams[names], hot)
        new = np.append(True, (names[1:] != names[:-1]) | (window[1:] != window[:-1] + 1)) | single
        new[1:] |= single[:-1]
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(window)) - 1
        a_word, b_word = window[a], window[b] + WINDOW - 1
        key = np.where(single[a], full[a_word], grams[names[a]])
        content = mix(full[a_word] + mix(full[window[b]] + (b - a).astype(np.uint64)))
        doc = np.searchsorted(first, a_word, "right") - 1
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
        place = (batch.column("number").to_numpy()[doc] << PLACE) + a_word - first[doc]
        order = np.lexsort((ids, content))
        start = np.flatnonzero(np.append(True, np.diff(content[order]) != 0))
        rep = order[start]
        size = np.diff(np.append(start, len(order)))
        last = order[start + size - 1]
        kind = np.where(single[a][rep], 1 + (ids[last] != ids[rep]), 0).astype(np.int8)
        listed = np.repeat(kind == 0, size)
        offs = pa.array(np.append(0, np.cumsum(np.where(kind == 0, size, 0))).astype(np.int32))
        order = order[listed]
        bucket = np.full(len(rep), batch.column("bucket")[0].as_py())
        out.append(
            pa.Table.from_arrays(
                [pa.array(key[rep].view(np.int64)), pa.array(bucket), pa.array(kind), _slices(raw, starts[a_word[rep]], ends[b_word[rep]]), pa.array(ids[rep]), pa.ListArray.from_arrays(offs, pa.array(ids[order])), pa.ListArray.from_arrays(offs, pa.array(place[order]))],
                schema=_PIECES,
            )
        )
    return pa.concat_tables(out)


# Step 3: the shards

FOUND = "bucket long, ids array<long>, starts array<long>, ends array<int>, windows array<long>, firsts array<long>"
#: How many answers about single windows a task collects before it sends them.
ANSWERS = 1 << 20


def repeated(texts: pa.Array, own: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of words of the texts whose windows also stand in a text with a smaller ``own``: text, start, end, that ``own``."""
    _, _, _, first, words = _words(texts)
    ids = np.unique(words, return_inverse=True)[1] + 1
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    symbols = np.zeros(len(ids) + len(size), np.int64)  # 0 after each text
    symbols[np.arange(len(ids)) + text] = ids
    index = FMIndex(symbols, int(ids.max()) + 1 if len(ids) else 1, window)
    of = np.repeat(own, size + 1)[index.suffixes]
    group = index.common < window
    least = np.minimum.reduceat(of, np.flatnonzero(group))[np.cumsum(group) - 1]
    length, where = index.matching_statistics(ids, first)
    hit = (length >= window) & (least[where] < np.repeat(own, size)) if len(ids) else np.zeros(0, bool)
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at, at
    new = np.append(True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]))
    a = at[new]
    b = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return text[a], a - first[text[a]], b - first[text[a]] + window, least[where[a]]


def _by_bucket(bucket: np.ndarray, order: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Answers of ``order``, whose buckets ascend, one row for each bucket; columns that are not given are empty."""
    bucket = bucket[order]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    offs, none = pa.array(np.append(edge, len(bucket)).astype(np.int32)), pa.array(np.zeros(len(edge) + 1, np.int32))
    kinds = {"ids": np.int64, "starts": np.int64, "ends": np.int32, "windows": np.int64, "firsts": np.int64}
    lists = [pa.ListArray.from_arrays(offs, pa.array(columns[c][order].astype(k))) if c in columns else pa.ListArray.from_arrays(none, pa.array(np.zeros(0, k))) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), *lists], names=["bucket", *kinds])


class _Singles:
    """Single windows, rows in order of key and own: which of them are indexed, and the answers for all others."""

    def __init__(self):
        self.waiting, self.n = [], 0
        self.key, self.seen = None, {}  # of the key that rows came of last: text -> first document, rows so far

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows to index; the answers for the others wait to be sent."""
        key, own = batch.column("key").to_numpy(), batch.column("own").to_numpy()
        code = batch.column("text").dictionary_encode()
        texts, code = code.dictionary, code.indices.to_numpy()
        rank = np.cumsum(np.append(0, key[1:] != key[:-1]))
        _, first, group, size = np.unique(rank * len(texts) + code, return_index=True, return_inverse=True, return_counts=True)
        by = np.argsort(group, kind="stable")
        nth = np.empty(len(key), np.int64)
        nth[by] = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
        least = own[first]
        # A key's rows may go on from the batch before.
        for g in np.flatnonzero(key[first] == self.key) if self.key is not None else ():
            known = self.seen.get(texts[code[first[g]]].as_py())
            if known:
                least[g] = known[0]
                nth[group == g] += known[1]
        if key[-1] != self.key:
            self.key, self.seen = key[-1], {}
        for g in np.flatnonzero(key[first] == self.key):
            self.seen[texts[code[first[g]]].as_py()] = int(least[g]), int(nth[group == g].max()) + 1
        told = (nth > 1) | (batch.column("single").to_numpy() == 2)  # else the index tells the second
        self.add(batch.column("bucket").to_numpy()[told], key[told], least[group][told])
        return batch.filter(pa.array(nth < 2))

    def add(self, bucket, key, least):
        self.waiting.append((bucket, key, least))
        self.n += len(bucket)

    def flush(self):
        bucket, key, least = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        return _by_bucket(bucket, np.lexsort((key, bucket)), {"windows": key, "firsts": least})


def _shard(rows: pa.Table, singles: _Singles) -> pa.RecordBatch:
    own, bucket = rows.column("own").to_numpy(), rows.column("bucket").to_numpy()
    texts = rows.column("text").combine_chunks()
    ids, places = rows.column("ids").combine_chunks(), rows.column("places").combine_chunks()
    at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    ids, places = ids.flatten().to_numpy(), places.flatten().to_numpy()
    piece = np.repeat(np.arange(len(own)), np.diff(at))
    size = np.diff(word_spans(*utf8(texts))[2])
    # Other documents than the first of an equal piece lose all of it.
    later = np.flatnonzero(ids != own[piece])
    found = [(piece[later], ids[later], places[later], places[later] + size[piece[later]])]
    k, a, b, least = repeated(texts, own)
    alone = rows.column("single").to_numpy()[k] > 0
    singles.add(bucket[k[alone]], rows.column("key").to_numpy()[k[alone]], least[alone])
    k, a, b = k[~alone], a[~alone], b[~alone]
    same = np.flatnonzero(ids == own[piece])  # the first document may have the piece at several places
    n = np.bincount(piece[same], minlength=len(own))
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    pick = same[np.repeat(begin[k], n[k]) + np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])] if len(k) else same[:0]
    a, b = np.repeat(a, n[k]), np.repeat(b, n[k])
    found.append((piece[pick], ids[pick], places[pick] + a, places[pick] + b))
    piece, ids, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, ids, bucket[piece]))
    return _by_bucket(bucket[piece], order, {"ids": ids, "starts": start, "ends": end & ((1 << PLACE) - 1)})


def _shards(batches):
    """Pieces in order of their keys, some whole keys at a time."""
    waiting, words, singles = [], 0, _Singles()
    for batch in batches:
        for single in (False, True):
            part = batch.filter(pa.array((batch.column("single").to_numpy() > 0) == single))
            if part.num_rows and single:
                part = singles.take(part)
            if part.num_rows:
                waiting.append(part)
                words += int(np.diff(utf8(part.column("text"))[1]).sum()) // 6
        if singles.n >= ANSWERS:
            yield singles.flush()
        if words < SYMBOLS:
            continue
        rows = pa.Table.from_batches(waiting)
        rows = rows.take(pa.array(np.argsort(rows.column("key").to_numpy(), kind="stable")))
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield _shard(rows.slice(0, cut), singles)
            waiting = rows.slice(cut).combine_chunks().to_batches()
            words = words * (len(key) - cut) // len(key)
    if waiting:
        yield _shard(pa.Table.from_batches(waiting), singles)
    if singles.n:
        yield singles.flush()


# Step 4: the texts that are left

KEPT = "doc_id long, n_words long, n_removed long, kept string"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _flat(rows: pa.Table, *columns) -> list[np.ndarray]:
    return [rows.column(c).combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.int64) for c in columns]


def _covered(batch: pa.RecordBatch, windows: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word lies under one of the single windows that its document isn't the first to have; the texts' first words."""
    _, _, _, first, words = _words(batch.column("text"))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    full = gram_hashes(words, WINDOW).view(np.int64)
    inside = text[: len(full)] == text[WINDOW - 1 :][: len(full)]
    at = np.minimum(np.searchsorted(windows, full), len(windows) - 1)
    doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(inside & (windows[at] == full) & (firsts[at] < doc[text[: len(full)]]))
    cover = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + WINDOW, minlength=len(words) + 1)
    return np.cumsum(cover[:-1]) > 0, first


def _keep(docs: pa.Table, found: pa.Table) -> pa.Table:
    ids, starts, ends, windows, firsts = _flat(found, "ids", "starts", "ends", "windows", "firsts")
    order = np.lexsort((starts, ids))
    ids, starts, ends = ids[order], starts[order], ends[order]
    order = np.lexsort((firsts, windows))
    windows, firsts = windows[order], firsts[order]
    out = [_KEPT.empty_table()]
    for batch in chunks(_numbered(docs).select(["doc_id", "text", "number", "no_id"]).to_batches(), "text"):
        raw, offs = utf8(batch.column("text"))
        raw, offs = raw.tobytes(), offs.tolist()
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        number = batch.column("number").to_pylist()
        low, high = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        under, first = _covered(batch, windows, firsts) if len(windows) else (None, None)
        n, gone, kept = [], [], []
        for k in range(len(doc)):
            words = raw[offs[k] : offs[k + 1]].split()
            n.append(len(words))
            left = None
            if under is not None and under[first[k] : first[k + 1]].any():
                left = ~under[first[k] : first[k + 1]]
            if high[k] > low[k]:
                # Of the doc_id's intervals, those of this text.
                a, b = low[k] + np.searchsorted(starts[low[k] : high[k]], [number[k] << PLACE, (number[k] + 1) << PLACE])
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts[a:b] & ((1 << PLACE) - 1), 1)
                np.add.at(cover, ends[a:b], -1)
                free = np.cumsum(cover[:-1]) == 0
                left = free if left is None else left & free
            if left is not None:
                words = [words[i] for i in np.flatnonzero(left).tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        doc = pa.array(doc, mask=batch.column("no_id").to_numpy(zero_copy_only=False))
        out.append(pa.Table.from_arrays([doc, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=_KEPT))
    return pa.concat_tables(out)


def remove_repeated(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept, the words that stay, joined by one blank."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(doc_id, F.lit(LAST_ID)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = partitions(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(parts, -(-int(size) // BUCKET_BYTES))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    # A bucket is a partition of its own as long as there are few; by hashes of their numbers, several would meet in one task.
    most = min(buckets, MOST_PARTS)
    to = lambda rows: rows.withColumn("place", F.pmod("bucket", F.lit(most)).cast("int")).repartitionById(most, F.col("place"))
    by = lambda rows: rows.groupBy("place", "bucket")
    sent = docs.mapInArrow(_send(most), SENT).withColumn("place", F.col("place").cast("int")).repartitionById(most, F.col("place"))
    each = sent.select(F.explode(F.arrays_zip("keys", "buckets", "n")).alias("x"))
    named = each.select(F.col("x.keys").alias("key"), F.col("x.buckets").cast("long").alias("bucket"), F.col("x.n").alias("n")).sortWithinPartitions("key")
    answer = to(named.mapInArrow(_shared, "bucket long, keys binary, hot binary"))
    dealt = to(docs.withColumn("bucket", F.col("bucket").cast("long")))
    pieces = by(dealt).cogroup(by(answer)).applyInArrow(_pieces, PIECES)
    shards = pieces.repartition(most, "key").sortWithinPartitions("key", "own")
    found = to(shards.mapInArrow(_shards, FOUND))
    return by(dealt).cogroup(by(found)).applyInArrow(_keep, KEPT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM x JOIN m USING (s), unnest(range(0, 13)) AS t(j) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
