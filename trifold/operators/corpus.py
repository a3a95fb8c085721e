"""Canonical drafts: matches joined with their players, validated and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(matches: DataFrame, players: DataFrame, known_ids: int | None = None) -> DataFrame:
    """Matches with arrays a and b of picks in slot order, controls, and the first reason to drop them, if any.

    Players are grouped by match and then joined, which takes one shuffle of each
    table; filter the players first where few matches are asked for."""
    row = F.struct("team_idx", "slot", "brawler_id", "player_tag", F.coalesce("power", F.lit(0.0)).alias("power"), F.coalesce("trophies", F.lit(0.0)).alias("trophies"))
    grouped = players.groupBy("match_id").agg(F.array_sort(F.collect_list(row)).alias("ps"))
    df = matches.join(grouped, "match_id", "left")
    team = lambda k: F.filter("ps", lambda p: p["team_idx"] == k)
    picks = lambda k: F.transform(team(k), lambda p: p["brawler_id"])
    df = df.withColumn("a", picks(0)).withColumn("b", picks(1))
    distinct = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    reason = F.when(F.col("ps").isNull(), "noPlayers").when(F.size("ps") != 6, "wrongCount").when((F.size("a") != 3) | (F.size("b") != 3), "badTeams")
    if known_ids is not None:
        reason = reason.when(F.exists("ps", lambda p: p["brawler_id"].isNull() | (p["brawler_id"] >= known_ids)), "unknownBrawler")
    reason = reason.when(~distinct("a") | ~distinct("b"), "dupBrawler").otherwise("ok")
    mean = lambda k, f: F.aggregate(team(k), F.lit(0.0), lambda acc, p: acc + p[f]) / 3
    return df.select(
        *matches.columns,
        "a",
        "b",
        reason.alias("drop_reason"),
        (mean(0, "power") - mean(1, "power")).alias("power_diff"),
        (F.log1p(mean(0, "trophies")) - F.log1p(mean(1, "trophies"))).alias("trophy_diff"),
        F.transform("ps", lambda p: p["player_tag"]).alias("tags"),
    )


def drop_counts(assembled: DataFrame) -> DataFrame:
    return assembled.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def swap_sides(df: DataFrame, key: str = "match_id") -> DataFrame:
    """Half of the matches, by a hash of their key, with teams and label exchanged, so that neither side is favoured."""
    flip = F.pmod(F.xxhash64(F.lit("side"), key), F.lit(2)) == 1
    put = {"a": F.when(flip, F.col("b")).otherwise(F.col("a")), "b": F.when(flip, F.col("a")).otherwise(F.col("b")), "y": F.when(flip, 1 - F.col("y")).otherwise(F.col("y"))}
    return df.withColumns(put)
