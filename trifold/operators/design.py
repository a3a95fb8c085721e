"""Design rows of the antisymmetric models, in long form: match_id, feature, value.

A feature is positive for team 0 and negative for team 1, so exchanging the
teams changes every sign and no intercept is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import pair_index
from trifold.operators.pairs import cross_team, same_team
from trifold.sources.bind import CLASSES, N, TRAITS, class_of

Entry = Column  # array of struct(feature, value)


def _entry(name: Column, value) -> Column:
    return F.struct(name.alias("feature"), F.lit(value).cast("double").alias("value") if not isinstance(value, Column) else value.cast("double").alias("value"))


def solo(cell: Column | None = None, block: str = "solo") -> Entry:
    """+1 for each own pick, -1 for each of theirs, by cell if given."""
    name = lambda x: F.concat_ws(":", F.lit(block), *([cell.cast("string")] if cell is not None else []), x.cast("string"))
    return F.concat(F.transform("a", lambda x: _entry(name(x), 1)), F.transform("b", lambda x: _entry(name(x), -1)))


def synergy() -> Entry:
    name = lambda p: F.concat_ws(":", F.lit("syn"), pair_index(p["i"], p["j"], N).cast("string"))
    return F.concat(F.transform(same_team("a"), lambda p: _entry(name(p), 1)), F.transform(same_team("b"), lambda p: _entry(name(p), -1)))


def counter() -> Entry:
    name = lambda p: F.concat_ws(":", F.lit("ctr"), pair_index(p["ours"], p["theirs"], N).cast("string"))
    return F.transform(cross_team("a", "b"), lambda p: _entry(name(p), p["sign"]))


def _once(value: Column, of) -> Column:
    """``of(value)``, for which the value is made once however often it is named."""
    return F.element_at(F.transform(F.array(value), of), 1)


def theory() -> Entry:
    """Differences of class counts, coverage, redundancy, and artillery and assassin asymmetries."""
    return _once(F.struct(*[F.transform(t, class_of).alias(t) for t in ("a", "b")]), _theory)


def _theory(classes: Column) -> Entry:
    n = lambda t, *cs: F.size(F.filter(classes[t], lambda x: x.isin(list(cs))))
    diff = lambda f: f("a") - f("b")
    coverage = lambda t: F.size(F.array_distinct(classes[t]))
    redundancy = lambda t: F.coalesce(F.array_max(F.transform(classes[t], lambda x: F.size(F.filter(classes[t], lambda other: other == x)))), F.lit(0))
    rows = [_entry(F.lit(f"theory:{c}"), diff(lambda t, c=c: n(t, c))) for c in CLASSES]
    rows += [_entry(F.lit("theory:coverage"), diff(coverage)), _entry(F.lit("theory:redundancy"), diff(redundancy))]
    only = lambda own, other: ((n(own, "artillery") > 0) & (n(other, "artillery") == 0)).cast("int")
    rows.append(_entry(F.lit("theory:artillery_only"), only("a", "b") - only("b", "a")))
    hunt = lambda own, other: n(own, "assassin") * n(other, "artillery", "marksman")
    rows.append(_entry(F.lit("theory:hunt"), hunt("a", "b") - hunt("b", "a")))
    return F.array(*rows)


def stack() -> Entry:
    """Differences of the number of distinct classes and of the most frequent one's count."""
    return F.filter(theory(), lambda e: e["feature"].isin("theory:coverage", "theory:redundancy"))


def roles() -> Entry:
    """Differences of class counts."""
    return F.filter(theory(), lambda e: e["feature"].isin([f"theory:{c}" for c in CLASSES]))


def structure(traits: list[str] = TRAITS) -> Entry:
    """Differences of class counts times what the map is like: a column of the drafts for each trait, null counting as 0."""
    each = lambda t, of: F.transform(of, lambda e: _entry(F.concat(F.lit(f"structure:{t}:"), F.substring_index(e["feature"], ":", -1)), e["value"] * F.coalesce(F.col(t), F.lit(0.0))))
    return _once(roles(), lambda of: reduce(lambda x, y: F.concat(x, y), [each(t, of) for t in traits]))


def renamed(entries: Entry, block: str) -> Entry:
    """Entries under another block's name, and so its penalty."""
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{block}:"), F.substring_index(e["feature"], ":", -1)).alias("feature"), e["value"].alias("value")))


def matchup(cell: Column | None = None, block: str = "matchup") -> Entry:
    """Each own class against each of theirs, one feature for two classes, by cell if given."""
    name = lambda x, y: F.concat_ws(":", F.lit(block), *([cell.cast("string")] if cell is not None else []), F.concat(x, F.lit(">"), y))

    def entry(x, y):
        cx, cy = class_of(x), class_of(y)
        return _entry(name(F.least(cx, cy), F.greatest(cx, cy)), F.when(cx < cy, 1.0).when(cx > cy, -1.0).otherwise(0.0))

    return F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: entry(x, y))))


def counter_by(cell: Column) -> Entry:
    return F.transform(counter(), lambda e: F.struct(F.concat_ws(":", F.lit("ctr_mode"), cell.cast("string"), F.substring_index(e["feature"], ":", -1)).alias("feature"), e["value"].alias("value")))


def single(column: str) -> Entry:
    """A difference of the teams that is a column of the drafts, null counting as none."""
    return F.array(_entry(F.lit(f"{column}:"), F.coalesce(F.col(column), F.lit(0.0))))


#: Families of features by name.
FAMILIES = {
    "solo": lambda: solo(),
    "solo_mode": lambda: solo(F.col("mode"), "solo_mode"),
    "solo_map": lambda: solo(F.col("map_id"), "solo_map"),
    "solo_patch": lambda: solo(F.col("patch"), "solo_patch"),
    # Only matches of a known tier count.
    "solo_tier": lambda: F.filter(solo(F.col("tier"), "solo_tier"), lambda e: F.col("tier").isNotNull()),
    # Four bands of the day.
    "solo_hour": lambda: solo(F.floor(F.col("hour") / 6).cast("int"), "solo_hour"),
    "structure": lambda: structure(),
    "synergy": synergy,
    "counter": counter,
    "counter_mode": lambda: counter_by(F.col("mode")),
    "theory": theory,
    "roles": lambda: renamed(roles(), "role"),
    "stack": lambda: renamed(stack(), "stack"),
    "matchup": lambda: matchup(),
    "matchup_mode": lambda: matchup(F.col("mode"), "matchup_mode"),
    "popularity": lambda: single("popularity"),
    "power": lambda: single("power"),
    "mastery": lambda: single("mastery"),
    # No draft signal: whether the first team is favoured.
    "side": lambda: F.array(_entry(F.lit("side:"), 1)),
}


#: What a family reads besides the teams, by the column's name: the column, or what the family makes no difference of.
READS = {
    "solo_mode": lambda: {"mode": F.col("mode")},
    "solo_map": lambda: {"map_id": F.col("map_id")},
    "solo_patch": lambda: {"patch": F.col("patch")},
    "solo_tier": lambda: {"tier": F.col("tier")},
    "solo_hour": lambda: {"hour": F.floor(F.col("hour") / 6) * 6},
    "structure": lambda: {t: F.col(t) for t in TRAITS},
    "counter_mode": lambda: {"mode": F.col("mode")},
    "matchup_mode": lambda: {"mode": F.col("mode")},
    "popularity": lambda: {"popularity": F.col("popularity")},
    "power": lambda: {"power": F.col("power")},
    "mastery": lambda: {"mastery": F.col("mastery")},
}


def reads(families: list[str]) -> dict[str, Column]:
    """All that the families' entries depend on; the order of a team's picks is not part of it."""
    return reduce(lambda x, y: x | y, [READS[f]() for f in families if f in READS], {c: F.array_sort(c) for c in ("a", "b")})


def entries(families: list[str]) -> Entry:
    """All families' entries of a match; a feature may be named more than once."""
    return reduce(lambda x, y: F.concat(x, y), [FAMILIES[f]() for f in families])


def rows(drafts: DataFrame, families: list[str]) -> DataFrame:
    """Long rows; entries of a match that meet in one feature are added up within the row's array, so nothing is shuffled."""
    df = drafts.withColumn("_e", entries(families)).withColumn("_k", F.array_distinct(F.transform("_e", lambda e: e["feature"])))
    each = F.transform("_k", lambda k: F.struct(k.alias("feature"), F.aggregate(F.filter("_e", lambda e: e["feature"] == k), F.lit(0.0), lambda acc, e: acc + e["value"]).alias("value")))
    # Most matches name no feature twice, and take their entries as they are.
    each = F.when(F.size("_k") == F.size("_e"), F.col("_e")).otherwise(each)
    return df.select("match_id", F.explode(each).alias("e")).select("match_id", "e.feature", "e.value").where("value <> 0")
