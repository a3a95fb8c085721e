"""Knowledge texts: captions, template markup, aliases and claims."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions.text import alias_variants, clean_caption, stamp

OVERLAP = 40


def cues(files: DataFrame) -> DataFrame:
    """files: path, text in SRT form.  One row per cue with its start in seconds."""
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), r"\n\s*\n")).alias("n", "block"))
    head = r"(\d+):(\d+):(\d+)[,.]\d+ *-->[^\n]*\n"
    part = lambda k: F.regexp_extract("block", head, k).cast("long")
    rows = blocks.where(F.col("block").rlike(head))
    text = clean_caption(F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n", ""), r"\n", " "))
    return rows.select("path", "n", (part(1) * 3600 + part(2) * 60 + part(3)).alias("start"), text.alias("text"))


def without_overlap(cue_rows: DataFrame, key: str = "path", mark_every: int = 30) -> DataFrame:
    """Rolling captions as one text per key: of each cue, the longest beginning
    that equals the text's end so far (OVERLAP words at most) goes, and a time
    mark stands wherever ``mark_every`` seconds have passed.

    A fold over one file's cues in order; files are the unit of work."""
    cue = F.struct("start", "n", F.split("text", " +").alias("words"))
    rows = cue_rows.where(F.col("text") != "").groupBy(key).agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("tail"), F.lit(-1).cast("long").alias("mark"))

    def step(acc, c):
        w, tail = c["words"], acc["tail"]
        size = F.least(F.size(w), F.size(tail), F.lit(OVERLAP))
        lengths = F.filter(F.sequence(F.lit(0), size), lambda k: (k == 0) | (F.slice(w, 1, F.greatest(k, F.lit(1))) == F.slice(tail, F.size(tail) - k + 1, F.greatest(k, F.lit(1)))))
        new = F.slice(w, F.array_max(lengths) + 1, F.size(w))
        due = F.floor(c["start"] / mark_every) > acc["mark"]
        marked = F.when(due & (F.size(new) > 0), F.concat(F.array(stamp(c["start"])), new)).otherwise(new)
        kept = F.concat(tail, new)
        kept = F.slice(kept, F.greatest(F.size(kept) - OVERLAP + 1, F.lit(1)), OVERLAP)
        return F.struct(F.concat(acc["out"], marked).alias("out"), kept.alias("tail"), F.when(due & (F.size(new) > 0), F.floor(c["start"] / mark_every)).otherwise(acc["mark"]).alias("mark"))

    return rows.select(key, F.aggregate("cues", start, step, lambda acc: F.array_join(acc["out"], " ")).alias("text"))


_NAME = re.compile(r"\w*")
_BRACES = re.compile(r"\{\{|\}\}")
_MARKS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)


def templates(text: str) -> list[tuple[str, int, int]]:
    """Name, start and end of every template, in order of their starts, by a stack of open
    braces; one that is never closed ends with the text."""
    out, open_ = [], []
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            open_.append(len(out))
            out.append([m.start(), len(text), False])
        elif open_:
            k = open_.pop()
            out[k][1:] = [m.end(), True]
    name = lambda at: _NAME.match(text, at + 2).group()
    return [(name(a), a, b) for a, b, closed in out if closed or name(a)]


def own_fields(block: str) -> dict[str, str]:
    """The fields between a template's own bars, by lower-case name; the first of a name counts."""
    inside = block[2 : -2 if block.endswith("}}") else len(block)]
    parts, depth, at = [], 0, 0
    for m in _MARKS.finditer(inside):
        if m.group() == "|":
            if not depth:
                parts.append(inside[at : m.start()])
                at = m.end()
        else:
            depth = max(0, depth + (1 if m.group() in ("{{", "[[") else -1))
    out: dict[str, str] = {}
    for part in [*parts, inside[at:]][1:]:
        key, sign, value = part.partition("=")
        if sign:
            out.setdefault(key.strip().lower(), " ".join(value.lstrip().split("\n", 1)[0].split()))
    return out


FIELDS = ["map", "maptype", "t1c1", "t1b1", "score1", "score2", "winner"]


def _records(outer, inner):
    def run(batches):
        for batch in batches:
            rows = []
            for page, text in zip(batch.column("page").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parent: dict[str, str] | None = None
                text = _COMMENT.sub("", text or "")
                for pos, (name, a, b) in enumerate(templates(text)):
                    if name == outer:
                        parent = own_fields(text[a:b])
                    elif name == inner and parent is not None and text[a:b].endswith("}}"):
                        own = own_fields(text[a:b])
                        rows.append((page, pos, parent.get("date") or None, *[own.get(f) or None for f in FIELDS]))
            columns = list(zip(*rows, strict=True)) or [[]] * (3 + len(FIELDS))
            types = [pa.string(), pa.int32(), *[pa.string()] * (1 + len(FIELDS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page", "pos", "date", *FIELDS])

    return run


def template_records(pages: DataFrame, outer: str = "Match", inner: str = "Map") -> DataFrame:
    """pages: page, text in template markup.  One row per ``{{Map`` template that
    is closed, with its own fields' text and the date of the ``{{Match`` before it.

    Templates nest, so their ends are found by counting braces, one page at a time."""
    schema = "page string, pos int, date string, " + ", ".join(f"{f} string" for f in FIELDS)
    return pages.select("page", "text").mapInArrow(_records(outer, inner), schema)


def aliases(names: DataFrame, stop: list[str]) -> DataFrame:
    """names: id, name.  Their alias forms, and whether any is a common word."""
    rows = names.select("id", "name", alias_variants("name").alias("aliases"))
    return rows.withColumn("ambiguous", F.arrays_overlap("aliases", F.array(*map(F.lit, stop))))


def collisions(alias_rows: DataFrame) -> DataFrame:
    """Aliases that several names own."""
    each = alias_rows.select("name", F.explode("aliases").alias("alias"))
    owners = each.groupBy("alias").agg(F.count_distinct("name").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
    return owners.where("n > 1").select("alias", "n", F.array_join("names", ",").alias("names"))


def with_defaults(claims: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null fields of a claim take the defaults."""
    return claims.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def documents(claims: DataFrame) -> DataFrame:
    """Per type a JSON document with its claims by source; claims are counted before anything is nested."""
    by = claims.groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"))
    nested = by.groupBy("type").agg(F.sum("n").alias("claims"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    return nested.select("type", F.to_json(F.struct("type", "claims", "sources")).alias("document"))
