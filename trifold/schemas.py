"""Table schemas, column allow-lists and columns that no feature may read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Table -> columns in DDL form.
DDL = {
    "players": "tag string, first_seen bigint, last_polled_at bigint, next_poll_at bigint, poll_interval_sec int, priority_score double, ranked_activity_score double, redundancy double, new_battles_last_poll int, consecutive_empty_polls int, discovered_via string, is_active int, enriched_at bigint, ranked_season_id int, ranked_rank int, ranked_rank_name string, ranked_elo int, highest_season_rank int, highest_alltime_rank int, highest_alltime_name string, proxy_trophies int, proxy_brawler_count int, proxy_mean_brawler_pow double",
    "battles_raw": "match_id string, battle_time string, raw_json string, first_seen_at bigint, discovered_from_tag string, seen_count int",
    "matches": "match_id string, battle_time string, battle_type string, is_ranked int, mode string, event_mode string, map_id int, map_name string, duration int, winning_team_idx int, star_player_tag string, team_size int, trophy_change int, patch_id string, ingested_at bigint",
    "match_players": "match_id string, player_tag string, team_idx int, slot int, brawler_id int, brawler_power int, brawler_trophies int",
    "crawl_log": "ts bigint, endpoint string, tag string, status int, latency_ms int, battles_returned int, new_matches int, ranked_new int, suspected_loss int",
    "shape_rejections": "ts bigint, tag string, reason string, battle_mode string, battle_type string, raw_json string",
    "patches": "patch_id string, start_time string, end_time string, notes_url string",
    "reference_cache": "kind string, reference_version string, payload string, fetched_at bigint",
}

#: One item of a battle log.
BATTLE = "struct<battleTime:string,event:struct<id:bigint,mode:string,map:string>,battle:struct<mode:string,type:string,result:string,duration:int,trophyChange:int,`rank`:int,starPlayer:struct<tag:string>,teams:array<array<struct<tag:string,brawler:struct<id:int,power:int,trophies:int>>>>,players:array<struct<tag:string>>>>"

#: What a feature may read of a match and of a player before the match.
MATCH_COLUMNS = ["match_id", "t", "mode", "map_id", "patch_id", "winning_team_idx"]
PLAYER_COLUMNS = ["match_id", "team_idx", "slot", "brawler_id", "player_tag"]
CONTROL_COLUMNS = ["power", "trophies"]
#: Known only after the match; a feature that reads one leaks the outcome.
POST_GAME = {"duration", "star_player_tag", "trophy_change", "result", "rank"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def feature_safe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns of an allow-list; an error if that names a post-game column."""
    leaks = POST_GAME & set(columns)
    if leaks:
        raise ValueError(f"columns known only after the match: {sorted(leaks)}")
    return df.select(*columns)
