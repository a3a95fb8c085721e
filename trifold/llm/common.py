"""Shared helpers of the corpus operators: tables, durable checkpoints and
whole-batch text handling in numpy.

Text helpers work on the UTF-8 bytes of a whole Arrow column at once.  The
separators that they look for are ASCII, which never occurs inside a multi-byte
character, so cutting bytes is the same as cutting code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.session import durable, shared_folder

#: The white space of every contract here: blank and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to ``path``, or to the shared folder, and read again."""
    path = path or f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id="doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; false without a doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: The column that ``numbered`` adds, and up to how many of its values (16 bytes each) are broadcast.
ROW, FEW_ROWS = "_row_number_of_trifold", 1_000_000


def numbered(docs: DataFrame, as_read: bool = False) -> DataFrame:
    """``docs`` with ROW, which tells every row from all others, equal ones too, however often the plan runs.

    ``as_read`` says that ``docs`` is Parquet as read, maybe filtered: a row is
    then known by the hash of its file's path and its place there.  Any other
    DataFrame is stored first."""
    if as_read:
        at = docs.metadataColumn("_metadata")
        return docs.withColumn(ROW, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")))
    return stored(docs.withColumn(ROW, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))))


def by_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Numbered documents that are (left_semi) or aren't (left_anti) among ``rows``, distinct
    values of ROW.  Few are broadcast, which leaves the texts where they are."""
    rows = durable(rows.select(ROW))
    return docs.join(F.broadcast(rows) if rows.count() <= FEW_ROWS else rows.hint("merge"), ROW, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of ``column`` each
    (a single longer text stays whole), nulls replaced by empty texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        batch = batch.set_column(k, column, pc.fill_null(batch.column(k).cast(pa.string()), ""))
        _, offs = utf8(batch.column(k))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins (one more for the end)."""
    col = col.cast(pa.string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lookup(true_at: bytes, size: int = 256) -> np.ndarray:
    out = np.zeros(size, bool)
    out[list(true_at)] = True
    return out


IS_WORD = ~lookup(SPACES)
#: A-Z to lower case, by bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across two texts, and the first word of each text (one more for the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time for all of them at once."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, rest, who = starts, size, None
    while len(at):
        x = eight[at]
        short = rest < 8
        x[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        if who is None:
            h = mix(h ^ x)
        else:
            h[who] = mix(h[who] ^ x)
        more = np.flatnonzero(rest > 8)
        who = more if who is None else who[more]
        at, rest = at[more] + 8, rest[more] - 8
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes, across text borders too."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : len(words) - k + 1 + j]
    return mix(out)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the position of its smallest one (the leftmost of equals)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Leftmost minima of spans of 2, 4, 8 ... values; two overlapping spans cover the window.
    best, span = np.arange(len(values)), 1
    while span * 2 <= w:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[w - span : w - span + n]
    return np.where(values[b] < values[a], b, a)


#: A key with over 1/HOT of all rows is hot; there are fewer than HOT of those.
HOT = 1000


def to_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Rows joined to their group, ``groups`` having one row per key with its number of rows in ``size``.

    Hot groups are fewer than HOT, so they are broadcast and their rows stay
    where they are; all other keys take a sort-merge join, in which no key has
    over 1/HOT of the rows."""
    hot = groups.where(F.col(size) * HOT > n_rows)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * HOT <= n_rows).hint("merge"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by the first column as lists of numpy columns, each holding whole keys; a key may span batches."""
    rest, more = None, []
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(now[0]):
            continue
        if rest is not None and now[0][-1] == rest[0][-1]:
            more.append(now)  # one key goes on
            continue
        now = [np.concatenate(x) for x in zip(*([rest] if rest is not None else []), *more, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last:
            yield [x[:last] for x in now]
        rest, more = [x[last:].copy() for x in now], []
    if rest is not None:
        yield [np.concatenate(x) for x in zip(rest, *more, strict=True)]
