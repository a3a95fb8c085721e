"""Sound keys and misheard names on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trifold.functions.text import sound_key
from trifold.operators import misheard


@pytest.mark.parametrize(("one", "other", "same"), [("Colt", "kolt", True), ("Phil", "fill", True), ("knife", "Nife", True), ("Edgar", "etker", True), ("Eve", "Ave", True), ("Byron", "piron", True), ("coco", "ko", False), ("Max", "mats", False), ("123", "", True), ("", "a", False)])
def test_sound(spark, one, other, same):
    a, b = spark.range(1).select(sound_key(F.lit(one)), sound_key(F.lit(other))).first()
    assert (a == b) == same


def test_words(spark):
    t = spark.createDataFrame([("El Primo, el primo!",), (None,), ("",), ("  7 ",), ("Hi",)], "text string")
    got = {r["word"]: r["n"] for r in misheard.caption_words(t).collect()}
    assert got == {"el": 2, "primo": 2, "elprimo": 2, "primoel": 1, "hi": 1}
    assert misheard.caption_words(t.limit(0)).count() == 0


def test_heard(spark):
    names = spark.createDataFrame([(1, "El Primo"), (2, "Colt"), (3, "Kolta"), (4, None), (5, "Bo"), (6, "Poco")], "id int, name string")
    f = misheard.forms(names, "id", "name")
    assert {r["form"] for r in f.where("name_id = 1").collect()} == {"elprimo", "elprimos"}
    words = spark.createDataFrame([("elpremo", 3), ("kolt", 5), ("koltt", 1), ("colt", 9), ("boko", 2), ("poko", 70), ("calt", 1), ("bo", 4), ("zzz", 1)], "word string, n long")
    stop = spark.createDataFrame([("poko",), ("poko",)], "word string")
    got = {r["word"]: (r["name_id"], r["form"], r["distance"], r["n_names"], r["ambiguous"]) for r in misheard.heard(words, f, stop).collect()}
    # kolt is one edit from both names' forms; boko is two edits from poco, beyond a third of its letters.
    assert got == {
        "elpremo": (1, "elprimo", 1, 1, False), "kolt": (2, "colt", 1, 2, True), "koltt": (3, "kolta", 1, 1, False),
        "poko": (6, "poco", 1, 1, True), "calt": (2, "colt", 1, 1, False),
    }
    assert misheard.heard(words, f.limit(0), stop).count() == 0 and misheard.heard(words.limit(0), f, stop).count() == 0
