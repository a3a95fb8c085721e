"""Joins, lookups, set operations and keyed updates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trifold.functions.expr import n_rows, name_key
from trifold.functions.text import alias_variants
from trifold.operators import lookup, textkb
from trifold.plans.registry import query
from trifold.plans.views import CLASS, D, L, M, P, PATCH, POOL
from trifold.sources import bind, rest


@query(f"WITH {M}, {PATCH} SELECT match_id, patch_id FROM m LEFT JOIN patch ON start <= t AND (stop IS NULL OR stop > t)")
def patch_asof(spark, sf):
    return lookup.interval(bind.matches(spark, sf), bind.patches(spark), "t", ["patch_id"]).select("match_id", "patch_id")


@query(
    """WITH s AS (SELECT o_orderdate AS start, count(*) AS n_orders FROM orders GROUP BY 1), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, n_orders FROM l ASOF LEFT JOIN s ON l_shipdate >= start"""
)
def shipped_asof(spark, sf):
    """Each shipped item with the orders of the last day of orders before it: more segments than an array takes."""
    days = bind.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("start")).agg(n_rows().alias("n_orders"))
    rows = bind.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return lookup.interval(rows, days.withColumn("stop", F.lit(None).cast("timestamp_ntz")), "l_shipdate", ["n_orders"])


@query("SELECT CAST(page_id AS VARCHAR) AS key, CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 10 <> 3 THEN length(html) END AS n_chars, CASE WHEN page_id % 7 = 1 AND page_id % 10 <> 3 THEN 2 ELSE 1 END AS attempts FROM pages")
def fetched_pages(spark, sf):
    """Every page asked for through the paced client; the transport stands for a server that lacks some pages and fails at first for others."""
    asked = bind.table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("path"))
    got = rest.fetch(asked, bind.page_server(spark, sf), rate=1e6)
    return got.select("key", "status", F.char_length("body").alias("n_chars"), "attempts")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_at FROM conversations")
def nearest_preceding(spark, sf):
    c = bind.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return lookup.preceding(c, ["conv_id"], "turn", F.col("role") == "user", "turn", "asked_at").drop("role")


@query(
    f"""WITH {P}, dim AS (SELECT CAST(i AS INT) AS brawler_id, {CLASS}[i % 7 + 1] AS class FROM range(107) t(i)), old AS (SELECT * FROM dim WHERE brawler_id < 60), auth AS (SELECT brawler_id, class FROM dim WHERE brawler_id < 100 AND brawler_id % 3 = 0)
SELECT coalesce(auth.class, old.class, 'Unknown') AS class, count(*) AS n FROM p LEFT JOIN auth USING (brawler_id) LEFT JOIN old USING (brawler_id) GROUP BY 1"""
)
def class_merge(spark, sf):
    # An authoritative class goes before the older one, that before Unknown.  The dimension has n_rows() rows.
    dim = bind.characters(spark)
    old = dim.where("brawler_id < 60").select("brawler_id", F.col("class").alias("old"))
    auth = dim.where("brawler_id < 100 AND brawler_id % 3 = 0").select("brawler_id", F.col("class").alias("auth"))
    merged = F.broadcast(dim.select("brawler_id").join(auth, "brawler_id", "left").join(old, "brawler_id", "left"))
    by = bind.players(spark, sf).groupBy("brawler_id").agg(n_rows().alias("k")).join(merged, "brawler_id", "left")
    return by.groupBy(F.coalesce("auth", "old", F.lit("Unknown")).alias("class")).agg(F.sum("k").alias("n"))


@query(
    f"""WITH {P}, {POOL}, r AS (SELECT match_id, ranked_rank, row_number() OVER (PARTITION BY match_id ORDER BY ranked_rank) AS k, count(*) OVER (PARTITION BY match_id) AS n FROM p JOIN pool ON tag = player WHERE ranked_rank IS NOT NULL)
SELECT match_id, ranked_rank AS median_rank, n AS n_known FROM r WHERE k = n // 2 + 1"""
)
def lobby_tier_median(spark, sf):
    known = bind.pool(spark, sf).where("ranked_rank IS NOT NULL").select(F.col("tag").alias("player"), "ranked_rank")
    rows = bind.players(spark, sf).select("match_id", "player").join(known, "player")
    ranks = rows.groupBy("match_id").agg(F.array_sort(F.collect_list("ranked_rank")).alias("r"))  # one match's players
    upper = F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int"))
    return ranks.select("match_id", upper.alias("median_rank"), F.size("r").cast("long").alias("n_known"))


NAMES = """dim AS (SELECT p_partkey AS id, p_name AS name FROM part), al AS (SELECT lower(replace(p_name, ' ', '-')) || 's' AS alias, p_partkey AS id FROM part WHERE p_partkey % 2 = 0),
asked AS (SELECT l_orderkey AS match_id, l_linenumber AS slot, CASE l_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '_') || 's' ELSE p_name || ' x' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
k1 AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM dim GROUP BY 1), k2 AS (SELECT regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM al GROUP BY 1)"""


def _asked(spark, sf):
    part = bind.table(spark, sf, "part").select("p_partkey", "p_name")
    rows = bind.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("s"))).otherwise(F.concat("p_name", F.lit(" x")))
    return rows.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("slot"), name.alias("name"))


def _dimension(spark, sf):
    part = bind.table(spark, sf, "part")
    dim = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    alias = F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.lit("s"))
    return dim, dim.where("id % 2 = 0").select(alias.alias("alias"), "id")


@query(f"WITH {NAMES} SELECT coalesce(k1.id, k2.id) AS id, count(*) AS n FROM asked LEFT JOIN k1 ON k1.k = regexp_replace(lower(asked.name), '[^a-z0-9]', '', 'g') LEFT JOIN k2 ON k2.k = regexp_replace(lower(asked.name), '[^a-z0-9]', '', 'g') GROUP BY 1")
def name_alias_join(spark, sf):
    dim, aliases = _dimension(spark, sf)
    # Distinct names are looked up, with their counts.
    names = _asked(spark, sf).groupBy("name").agg(n_rows().alias("k"))
    return lookup.by_name(names, "name", dim, aliases).groupBy("id").agg(F.sum("k").alias("n"))


@query(f"WITH {NAMES} SELECT name, count(*) AS n FROM asked WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN (SELECT k FROM k1) GROUP BY name ORDER BY n DESC, name LIMIT 15")
def unmatched_names(spark, sf):
    return lookup.unmatched(_asked(spark, sf), "name", _dimension(spark, sf)[0])


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS codename FROM part WHERE regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AND p_partkey % 4 = 0")
def codename_join(spark, sf):
    part = bind.table(spark, sf, "part")
    inside = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("codename"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).join(inside, "id").where(name_key("name") != name_key("codename"))


@query(f"WITH {P}, seed AS (SELECT c_custkey AS player FROM customer WHERE c_custkey % 5 = 0), fr AS (SELECT DISTINCT player FROM p WHERE player NOT IN (SELECT player FROM seed)) SELECT player, player * 7 % 100 AS admit FROM fr ORDER BY admit, player LIMIT 60")
def frontier_tags(spark, sf):
    seeds = bind.table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("player"))
    new = bind.players(spark, sf).select("player").distinct().join(seeds, "player", "left_anti")
    return new.withColumn("admit", F.col("player") * 7 % 100).orderBy("admit", "player").limit(60)


@query(
    """WITH n AS (SELECT p_partkey AS id, p_name AS name, lower(trim(p_name)) AS low FROM part), v AS (SELECT name, unnest(list_distinct(list_filter([low, regexp_replace(low, '[^a-z0-9 ]', '', 'g'), trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), regexp_replace(low, '[^a-z0-9]', '', 'g'),
 regexp_replace(low, '[^a-z0-9]', '', 'g') || 's', regexp_replace(low, '[^a-z0-9]', '', 'g') || '''s', regexp_replace(regexp_replace(low, '[^a-z0-9]', '', 'g'), 's$', '')], lambda x: x <> ''))) AS alias FROM n)
SELECT alias, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM v GROUP BY alias HAVING count(DISTINCT name) > 1"""
)
def alias_collisions(spark, sf):
    names = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return textkb.collisions(names.select("name", alias_variants("name").alias("aliases")))


@query(f"WITH {L} SELECT tag, max_by(endpoint, (epoch, event_id)) AS endpoint, max(epoch) AS epoch, max_by(event_id, (epoch, event_id)) AS event_id FROM l GROUP BY tag")
def upsert_latest(spark, sf):
    return lookup.latest(bind.poll_log(spark, sf).select("tag", "epoch", "event_id", "endpoint"), ["tag"], ["epoch", "event_id"])


@query(f"WITH {L} SELECT tag, count(*) AS seen_count, min(epoch) AS epoch, min_by(event_id, (epoch, event_id)) AS event_id, min_by(endpoint, (epoch, event_id)) AS endpoint FROM l GROUP BY tag")
def upsert_counter(spark, sf):
    return lookup.observed(bind.poll_log(spark, sf), "tag", "epoch", ["event_id", "endpoint"])


@query("SELECT l_orderkey AS match_id, '#' || l_suppkey AS queried_tag, count(*) AS seen_count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL")
def raw_observations(spark, sf):
    """Observations as they came, one row for each match and the tag whose log showed it."""
    rows = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.concat(F.lit("#"), F.col("l_suppkey")).alias("queried_tag"), F.col("l_shipdate").alias("at"))
    return rows.groupBy("match_id", "queried_tag").agg(F.count(F.lit(1)).alias("seen_count"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


@query(f"WITH {M}, w AS (SELECT '#' || l_suppkey AS queried_tag, max(t) AS watermark FROM lineitem JOIN m ON l_orderkey = match_id GROUP BY ALL) SELECT queried_tag, watermark, count(l_orderkey) AS later FROM w LEFT JOIN lineitem ON '#' || l_suppkey = queried_tag AND l_shipdate > watermark GROUP BY ALL")
def tag_watermarks(spark, sf):
    """Each tag's newest match, and how many of its observations came after that match."""
    rows = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.concat(F.lit("#"), F.col("l_suppkey")).alias("queried_tag"), F.col("l_shipdate").alias("at"))
    return lookup.watermarks(rows.join(bind.matches(spark, sf).select("match_id", "t"), "match_id", "left"), "queried_tag", "t", "at")


@query("SELECT c_custkey AS tag, min(c_nationkey) AS region FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey")
def insert_or_ignore(spark, sf):
    old = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tag"))
    new = bind.table(spark, sf, "customer").select(F.col("c_custkey").alias("tag"), F.col("c_nationkey").alias("region"))
    return lookup.insert_new(old, new, ["tag"])


@query(f"WITH {POOL}, ch AS (SELECT user_id AS tag, 2000000 + max(event_id) AS next_poll_at FROM events GROUP BY user_id) SELECT tag, is_active, coalesce(ch.next_poll_at, pool.next_poll_at) AS next_poll_at FROM pool LEFT JOIN ch USING (tag)")
def update_by_key(spark, sf):
    changes = bind.table(spark, sf, "events").groupBy(F.col("user_id").alias("tag")).agg((F.max("event_id") + 2_000_000).alias("next_poll_at"))
    return lookup.overwrite(bind.pool(spark, sf).select("tag", "is_active", "next_poll_at"), changes, ["tag"])


HALF = f"""{D}, pk AS (SELECT map_id, match_id % 2 AS half, unnest(list_concat(a, b)) AS brawler_id FROM d), c AS (SELECT map_id, half, brawler_id, count(*) AS n FROM pk GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY map_id, half ORDER BY n DESC, brawler_id) AS rank FROM c)"""


@query(f"WITH {HALF} SELECT x.map_id, round(count(y.brawler_id) / 10.0, 6) AS overlap FROM r x LEFT JOIN r y ON y.map_id = x.map_id AND y.brawler_id = x.brawler_id AND y.half = 1 AND y.rank <= 10 WHERE x.half = 0 AND x.rank <= 10 GROUP BY x.map_id")
def topk_overlap(spark, sf):
    picks = bind.drafts(spark, sf).select("map_id", (F.col("match_id") % 2).alias("half"), F.explode(F.concat("a", "b")).alias("brawler_id"))
    by = picks.groupBy("map_id", "half", "brawler_id").agg(n_rows().alias("n"))
    ranked = by.withColumn("rank", F.row_number().over(Window.partitionBy("map_id", "half").orderBy(F.desc("n"), "brawler_id")))
    out = lookup.overlap_at(ranked.where("half = 0"), ranked.where("half = 1"), ["map_id"], "brawler_id", 10)
    return out.select("map_id", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {M}, {P} SELECT match_id, mode FROM m WHERE EXISTS (SELECT 1 FROM p WHERE p.match_id = m.match_id) AND NOT EXISTS (SELECT 1 FROM p WHERE p.match_id = m.match_id AND p.power < 5)")
def existence_probe(spark, sf):
    p = bind.players(spark, sf)
    m = bind.matches(spark, sf).select("match_id", "mode").join(p.select("match_id"), "match_id", "left_semi")
    return m.join(p.where("power < 5").select("match_id"), "match_id", "left_anti")


@query(f"WITH {PATCH}, s AS (SELECT DISTINCT start FROM patch) SELECT patch_id, start, lead(start) OVER (ORDER BY start) AS next_start FROM patch")
def interval_end(spark, sf):
    seen = bind.matches(spark, sf).agg(F.max("t").alias("last")).select("last")  # only segments that have begun by then
    w = Window.orderBy("start")  # a handful of segments
    p = bind.patches(spark).withColumn("next_start", F.lead("start").over(w))
    return p.crossJoin(F.broadcast(seen)).where("start <= last OR last IS NULL").select("patch_id", "start", "next_start")


@query("SELECT source, count(*) AS n, count(quality) AS labelled, count(*) - count(quality) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def source_status(spark, sf):
    d, q = bind.table(spark, sf, "documents").select("doc_id", "source"), bind.table(spark, sf, "labels").select("doc_id", "quality")
    known = F.count("quality")
    return d.join(q, "doc_id", "left").groupBy("source").agg(n_rows().alias("n"), known.alias("labelled"), (n_rows() - known).alias("unlabelled"))
