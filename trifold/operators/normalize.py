"""Battle-log items to matches and participants, with reasons for those that are rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trifold.functions.expr import compact_timestamp, match_key, norm_tag, winner
from trifold.schemas import BATTLE
from trifold.sources.bind import RANKED

KNOWN_TYPES = [*RANKED, "ranked", "friendly", "challenge", "tournament"]


def parse(raw: DataFrame) -> DataFrame:
    """raw: item (JSON), queried_tag.  Adds the parsed item, its tags by team and the first reason to reject it, if any."""
    # A generator of one row, which filters on what is read from it aren't pushed through: each item is parsed once.
    df = raw.select("*", F.explode(F.array(F.from_json("item", BATTLE))).alias("it"))
    teams = F.col("it.battle.teams")
    tags = F.transform(teams, lambda t: F.transform(t, lambda p: norm_tag(p["tag"])))
    # So are its tags normalised: the reason reads them many times over.
    df = df.select("*", F.explode(F.array(F.struct(tags.alias("tags"), F.flatten(tags).alias("all_tags"), norm_tag("queried_tag").alias("me")))).alias("_own"))
    df = df.select(*[c for c in df.columns if c != "_own"], "_own.tags", "_own.me", "_own.all_tags")
    mine = F.array_position(F.transform("tags", lambda t: F.array_contains(t, F.col("me"))), True)
    reason = (
        F.when(F.col("it.battle").isNull(), "not an object")
        .when(F.col("it.battle.players").isNotNull() & teams.isNull(), "flat players")
        .when(teams.isNull(), "no teams")
        .when(F.size(teams) != 2, "expected 2 teams")
        .when(F.exists("tags", lambda t: F.size(t) == 0), "empty team")
        .when(F.exists("all_tags", lambda t: t.isNull()), "missing tag")
        .when(F.size(F.array_distinct("all_tags")) != F.size("all_tags"), "duplicate tag")
        .when(mine == 0, "not present")
    )
    return df.withColumn("my_team", (mine - 1).cast("int")).withColumn("reject_reason", reason)


def matches(parsed: DataFrame) -> DataFrame:
    b = F.col("it.battle")
    mode = F.coalesce(F.nullif(F.col("it.event.mode"), F.lit("")), b["mode"])
    return parsed.where("reject_reason IS NULL").select(
        match_key("it.battleTime", "all_tags").alias("match_id"),
        F.col("it.battleTime").alias("battle_time"),
        compact_timestamp("it.battleTime").alias("t"),
        b["type"].alias("battle_type"),
        b["type"].isin(RANKED).cast("int").alias("is_ranked"),
        b["mode"].alias("mode"),
        mode.alias("event_mode"),
        F.col("it.event.map").alias("map_name"),
        winner(b["result"], b["trophyChange"], "my_team").alias("winning_team_idx"),
        F.size(F.element_at("tags", 1)).alias("team_size"),
        "all_tags",
        "it",
        "queried_tag",
    )


def participants(found: DataFrame) -> DataFrame:
    """One row per match and player of ``matches``' rows."""
    teams = found.select("match_id", F.posexplode("it.battle.teams").alias("team_idx", "team"))
    rows = teams.select("match_id", "team_idx", F.posexplode("team").alias("slot", "p"))
    return rows.select("match_id", "team_idx", "slot", norm_tag("p.tag").alias("player_tag"), F.col("p.brawler.id").alias("brawler_id"), F.col("p.brawler.power").alias("brawler_power"), F.col("p.brawler.trophies").alias("brawler_trophies"))


def rejects(parsed: DataFrame) -> DataFrame:
    """Rejected items with a preview; the whole item stays in the raw table."""
    return parsed.where("reject_reason IS NOT NULL").select("queried_tag", F.col("reject_reason").alias("reason"), F.col("it.battle.mode").alias("battle_mode"), F.col("it.battle.type").alias("battle_type"), F.substring("item", 1, 4000).alias("preview"))


def unknown_types(found: DataFrame) -> DataFrame:
    return found.where(~F.col("battle_type").isin(KNOWN_TYPES)).groupBy("battle_type").agg(F.count(F.lit(1)).alias("n"))
