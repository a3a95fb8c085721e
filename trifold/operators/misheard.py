"""Names as captions mishear them: words that sound like a name and are written almost like it.

The sound of a word is its consonants with like ones taken as one, so words meet
names by an equality of sounds and only then are compared letter by letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions.text import alias_variants, sound_key
from trifold.session import durable, small


def caption_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n: runs of letters a to z, lower-cased, and two neighbours run together, with their number in all texts (null: none)."""
    t = texts.select(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)).alias("t"))
    joined = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), lambda x, y: F.concat(x, y))
    return t.select(F.explode(F.concat("t", joined)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def forms(names: DataFrame, name_id: str, name: str) -> DataFrame:
    """name_id, form, key: every way to write a name, letters alone, and its sound; forms under three letters are left out."""
    each = names.select(F.col(name_id).alias("name_id"), F.explode(alias_variants(name)).alias("form"))
    bare = each.select("name_id", F.regexp_replace("form", "[^a-z]", "").alias("form")).where(F.length("form") >= 3).distinct()
    return bare.withColumn("key", sound_key("form"))


def heard(words: DataFrame, names: DataFrame, stop: DataFrame, most: int = 2) -> DataFrame:
    """Per word that is no name's own form but sounds like one and lies within ``most`` edits (and a third of the form's letters) of it: the nearest form.

    words: word, n; names: as ``forms`` gives them; stop: word, the ordinary words.
    Columns: word, n, name_id, form, distance, n_names (names that are as near; ties
    go to the smaller form and id) and ambiguous: several names, or an ordinary word.
    A table of names beyond a broadcast's size is joined by a merge."""
    near = F.least(F.lit(most), F.floor(F.length("form") / 3).cast("int"))
    names = durable(names)
    low, high = names.agg(F.coalesce(F.min(F.length("form")), F.lit(0)), F.coalesce(F.max(F.length("form")), F.lit(0))).first()
    # No word of another length is near enough, so no sound is taken of it.
    words = words.where(F.length("word").between(low - most, high + most))
    other = words.join(small(names.select(F.col("form").alias("word")).distinct()), "word", "left_anti").withColumn("key", sound_key("word"))
    met = other.where("key <> ''").join(small(names), "key").withColumn("distance", F.levenshtein("word", "form"))
    at = met.where(F.col("distance").between(1, near)).groupBy("word", "n", "distance").agg(F.count_distinct("name_id").alias("n_names"), F.min(F.struct("form", "name_id")).alias("x"))
    best = at.groupBy("word", "n").agg(F.min(F.struct("distance", "n_names", "x")).alias("b"))
    flagged = best.join(stop.select("word", F.lit(True).alias("_stop")).distinct(), "word", "left")
    return flagged.select("word", "n", F.col("b.x.name_id").alias("name_id"), F.col("b.x.form").alias("form"), F.col("b.distance").alias("distance"), F.col("b.n_names").alias("n_names"), ((F.col("b.n_names") > 1) | F.col("_stop").isNotNull()).alias("ambiguous"))
