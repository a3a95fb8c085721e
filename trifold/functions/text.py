"""Text expressions: aliases, template fields and captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import _c, name_key


def alias_variants(name) -> Column:
    """Ways in which a name is written: raw, without punctuation, joined, spaced, plural, possessive, without final s."""
    low = F.lower(F.trim(_c(name)))
    bare = F.regexp_replace(low, "[^a-z0-9 ]", "")
    spaced = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    joined = name_key(_c(name))
    forms = F.array(low, bare, spaced, joined, F.concat(joined, F.lit("s")), F.concat(joined, F.lit("'s")), F.regexp_replace(joined, "s$", ""))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


#: Fixed values of the sound key: letters that count as others, and the consonants left.
LIKE, AS, CONSONANTS = "bcdgqvxz", "pktkkfss", "fjklmnprst"


def sound_key(word) -> Column:
    """How a word sounds: its consonants, like ones as one and double ones once; a vowel only counts at the start, as a.

    Letters other than a to z are left out; a word without any has an empty key."""
    low = F.regexp_replace(F.lower(_c(word)), "[^a-z]", "")
    out = F.translate(F.regexp_replace(F.regexp_replace(low, "ph", "f"), "^(kn|gn)", "n"), LIKE, AS)
    for c in CONSONANTS:
        out = F.regexp_replace(out, f"{c}+", c)
    # The first vowel is kept under a letter that the rest drops no more.
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "^[aeiou]+", "A"), "[aeiouhwy]", ""), "A", "a")


def without_comments(text) -> Column:
    return F.regexp_replace(_c(text), r"(?s)<!--.*?-->", "")


def template_pieces(text) -> Column:
    """The parts of a template's text between its own bars: of a template or link inside, bars don't part.

    Cut at every brace pair, bracket pair and bar, and put together again by depth."""
    tokens = F.regexp_extract_all(_c(text), F.lit(r"\{\{|\}\}|\[\[|\]\]|\||[^{}\[\]|]+|[{}\[\]]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        opens, closes = t.isin("{{", "[["), t.isin("}}", "]]")
        depth = F.greatest(acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        part = (t == "|") & (acc["depth"] <= 1)
        # The template's own braces are no part of a value.
        own = (opens & (acc["depth"] == 0)) | (closes & (acc["depth"] <= 1))
        now = F.when(part, F.lit("")).when(own, acc["now"]).otherwise(F.concat(acc["now"], t))
        return F.struct(depth.alias("depth"), now.alias("now"), F.when(part, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"])))


def template_field(text, field: str) -> Column:
    """The value of ``|field=...`` of a template, comments and extra blanks removed; null if absent.

    A value ends at the template's own next bar or at the end of its line; fields
    of templates inside it are not its own."""
    own = F.filter(template_pieces(without_comments(text)), lambda p: (F.instr(p, "=") > 0) & (F.lower(F.trim(F.substring_index(p, "=", 1))) == field.lower()))
    first = F.get(own, F.lit(0))
    line = F.substring_index(F.regexp_replace(F.substring(first, F.instr(first, "=") + F.lit(1), F.char_length(first)), r"^\s+", ""), "\n", 1)
    value = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(value != "", value)


def clean_caption(text) -> Column:
    """Without <tags>, {marks} and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"<[^>]*>|\{[^}]*\}", ""), r"\s+", " "))


def stamp(seconds) -> Column:
    """[MM:SS]"""
    s = _c(seconds).cast("long")
    return F.format_string("[%02d:%02d]", (s / 60).cast("long"), s % 60)


def fixed(x, digits: int) -> Column:
    """A number with that many decimals; halves of its shortest decimal form go away from 0."""
    return F.format_string(f"%.{digits}f", (F.col(x) if isinstance(x, str) else x).cast("double"))


def percent(share, digits: int = 1) -> Column:
    return F.concat(fixed((F.col(share) if isinstance(share, str) else share) * 100, digits), F.lit("%"))


def points(share, digits: int = 2) -> Column:
    """A difference of shares in percentage points, with its sign."""
    share = F.col(share) if isinstance(share, str) else share
    return F.concat(F.when(share >= 0, "+").otherwise(""), fixed(share * 100, digits), F.lit("pp"))


def padded(x, width: int, right: bool = False) -> Column:
    """Text filled up with blanks, before it if ``right``; longer text stays whole."""
    x = F.col(x) if isinstance(x, str) else x
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(x), F.lit(0)))
    return F.concat(fill, x) if right else F.concat(x, fill)


def csv_field(x) -> Column:
    """A field of a CSV line: quoted if it holds a comma, a quote or a line's end, quotes doubled; null is empty."""
    x = F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    return F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(*fields) -> Column:
    return F.concat_ws(",", *map(csv_field, fields))


def composition_key(classes) -> Column:
    """Three-letter classes in order, joined by +."""
    return F.array_join(F.array_sort(F.transform(_c(classes), lambda x: F.substring(x, 1, 3))), "+")
