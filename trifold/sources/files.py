"""Files in and out: nested logs, dimensions, captions, reports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.operators.textkb import cues

CHARACTER = "id:int,class:string,rarity:string,released:boolean,ambiguous:boolean,aliases:array<string>,dev_codename:string"


def landing(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Battle-log items of a landing folder, one JSON object a line: item, queried_tag.

    Lines hold {"queried_tag": ..., "item": {...}}; the item stays text, so nothing of it is lost."""
    reader = spark.readStream if stream else spark.read
    line = F.col("value")
    return reader.text(path).select(F.get_json_object(line, "$.item").alias("item"), F.get_json_object(line, "$.queried_tag").alias("queried_tag"))


def records(spark: SparkSession, path: str, fields: str, at: str | None = None, name: str = "name") -> DataFrame:
    """A JSON document as rows of ``name`` and ``fields`` (a struct's fields in DDL), whatever the file is called.

    ``at`` is the path of the part that is read, the whole document if None.  That part is an object of
    names to records, or an array of records, whose name is their place.  Missing fields are null, further ones are left out;
    a document without the part, or that is no JSON, has no rows."""
    whole = spark.read.text(path, wholetext=True).select((F.get_json_object("value", f"$.{at}") if at else F.trim("value")).alias("j"))
    listed = F.posexplode(F.from_json("j", f"array<struct<{fields}>>"))
    objects = whole.where("j LIKE '{%'").select(F.explode(F.from_json("j", f"map<string,struct<{fields}>>")).alias(name, "r"))
    arrays = whole.where("j LIKE '[%'").select(listed.alias("at", "r")).select(F.col("at").cast("string").alias(name), "r")
    return objects.unionByName(arrays).select(name, "r.*")


def dimension(spark: SparkSession, path: str, field: str = "brawlers") -> DataFrame:
    """A JSON object of names to characters as rows; of equal ids the name that sorts first stays."""
    rows = records(spark, path, CHARACTER, field)
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", "x.*")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file under a fixed schema; fields that are missing are null."""
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines, which ``jsonl`` reads with those before; null fields are left out."""
    df.write.mode("append").json(path)


def captions(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files, one file at a time."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return cues(files)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str, now: datetime.datetime) -> None:
    """Rows as JSON lines, each with the time of the report."""
    df.withColumn("generated", F.lit(now.isoformat())).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report as a table for readers; beyond ``most`` rows it is no report, and a sink should take it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with to_csv or to_json")
    if not rows:
        return "_no data yet_"
    text = lambda x: "" if x is None else str(x).replace("|", r"\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(text(x) for x in r) + " |" for r in rows])
