"""Exact deduplication with a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and
sorted by digest: digest, keep_id, keep_length, group_size, batch.  New documents
are deduplicated against it by a sort-merge anti-join on the digest and their new
digests are appended, so a digest is in it once, whatever the number of batches.
It lies under a path in a shared folder and outlives the session and its
catalog; its number of buckets is part of the folder's name there, and whoever
takes it up follows that.  keep_id is the best document of the batch that brought
the digest, group_size the number of its rows in that batch.  DataFrame and SQL
functions only.

A batch has a name and is a partition of its own.  It is compared with the other
batches and replaces itself, so a batch that was stopped anywhere, even after
its digests were written, gives the same rows when it is run again.

Groups are counted with a partial aggregate before any shuffle, so a group of
any size sends one row per task.  Rows return to their group by an equality
join; groups with over 1/HOT of all rows, of which there can be HOT - 1 at
most, take a broadcast of that bounded size instead, so no key lands in one
task.

Defined cases: a null text counts as empty, and empty texts are equal to each
other; of texts of equal length the smallest doc_id stays, a
null one last, and of rows that agree in both any one; decisions are made by row,
so of repeated rows one stays, and rows of one doc_id stay or go each by its own
text; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.session import children, remove, shared_folder

from .common import ROW, by_rows, durable, numbered, table, to_groups

WHITE = r"[\x20\x09-\x0D]+"
#: An index gets a bucket for so many rows, and BUCKETS at least.
ROWS_A_BUCKET, BUCKETS = 4_000_000, 64


def digests(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, digest (binary) and length in code points of each numbered document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(ROW, "doc_id", F.unhex(F.sha2(F.regexp_replace(text, WHITE, ""), 256)).alias("digest"), F.char_length(text).alias("length"))


def grouped(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays, the longest, then the smallest doc_id, and the number of rows."""
    best = F.min(F.struct((-F.col("length")).alias("neg"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), ROW))
    out = rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
    return out.select("digest", F.col("b.id").alias("keep_id"), (-F.col("b.neg")).alias("keep_length"), "group_size", F.col(f"b.{ROW}").alias("keep_row"))


class DigestIndex:
    """The index under ``path``; one that an earlier session left there is taken up again, with its own number of buckets."""

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_length INT, group_size BIGINT, batch STRING"
    #: What the folder's name says before the number of buckets.
    FOLDER = "buckets-"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        known = [int(x.removeprefix(self.FOLDER)) for x in children(spark, path) if x.startswith(self.FOLDER)]
        self.buckets = known[0] if known else buckets
        # The catalog's name is this object's own: the files are what lasts.
        self.name = f"digests_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/{self.FOLDER}{self.buckets}'"
        )
        if known:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    @classmethod
    def fresh(cls, spark: SparkSession, n_rows: int) -> DigestIndex:
        """An empty index in the shared folder, with buckets for ``n_rows`` documents."""
        return cls(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}", max(BUCKETS, -(-n_rows // ROWS_A_BUCKET)))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def put(self, groups: DataFrame, batch: str) -> None:
        """Writes the batch's digests, in place of those that it wrote before."""
        if not re.fullmatch("[A-Za-z0-9_-]+", batch):
            raise ValueError(f"{batch!r} is no name of letters, digits, - and _")
        # One task per bucket writes one sorted file per bucket.
        rows = groups.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "keep_length", "group_size").repartition(self.buckets, "digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {{rows}}", rows=rows)

    def admit(self, groups: DataFrame, batch: str) -> DataFrame:
        """Puts the groups whose digests no other batch has, and returns those."""
        others = self.read().where(F.col("batch") != batch).select("digest")
        new = durable(groups.join(others.hint("merge"), "digest", "left_anti"))
        self.put(new, batch)
        return new

    def close(self) -> None:
        """Forgets the catalog's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)


def classes(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The documents are admitted to ``index`` as ``batch``, a new one unless named,
    or to an index of their own, dropped afterwards.  keep_id is read back from
    it, so for a digest of another batch it is that batch's document and no row of
    this one is kept; group_size counts the rows of these documents."""
    own = index is None
    # The checkpoint fixes these numbers.
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = durable(digests(docs.select("doc_id", "text", number.alias(ROW))))
    n = rows.count()
    index = index or DigestIndex.fresh(docs.sparkSession, n)
    groups = durable(grouped(rows))
    new = index.admit(groups, batch or uuid.uuid4().hex).select("digest", "keep_row")
    groups = groups.select("digest", "group_size").join(index.read().select("digest", "keep_id").hint("merge"), "digest").join(new.hint("merge"), "digest", "left")
    out = to_groups(rows, groups, "digest", "group_size", n)
    kept = F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(False))
    out = durable(out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"))
    if own:
        index.drop()
    return out


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, as_read: bool = False, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns: the best row of each
    group whose digest no other batch of the index holds.

    They are admitted to ``index`` as ``batch``, a new one unless named; to an
    index of their own, dropped afterwards, if none is given.  ``as_read`` is that
    of ``numbered``."""
    own = index is None
    docs = numbered(docs, as_read)
    rows = durable(digests(docs))
    index = index or DigestIndex.fresh(docs.sparkSession, rows.count())
    new = index.admit(grouped(rows), batch or uuid.uuid4().hex)
    gone = rows.select(ROW).join(new.select(F.col("keep_row").alias(ROW)).hint("merge"), ROW, "left_anti")
    out = by_rows(docs, gone, "left_anti").drop(ROW)  # rests on checkpoints, no longer on the index
    if own:
        index.drop()
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
}
