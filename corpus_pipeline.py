"""The corpus pipeline: five stages, each written as Parquet and read again.

Quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination,
packing.  Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trifold.llm import decontaminate, exact, nearcopies, packing, quality
from trifold.llm.common import stored, table
from trifold.session import remove, shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs, as_read=True)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs, as_read=True)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("simhash near-dedup", dissimilar),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]
#: The classifier and the tokenizer are beyond SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        docs = stored(stage(spark, docs, sf_dir), path)
        if last:  # nothing reads a stage's documents once the next one's are written
            remove(spark, last)
        last = path
    return docs
