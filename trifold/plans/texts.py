"""Nested logs, captions, template markup and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from trifold.functions.expr import n_rows
from trifold.functions.text import csv_line, fixed, padded, percent, points
from trifold.operators import misheard, normalize, textkb
from trifold.plans.registry import query
from trifold.plans.views import M, P
from trifold.session import durable
from trifold.sources import bind


def _items(spark, sf):
    """Battle-log items as JSON, from orders and their lines."""
    row = F.struct("slot", "team_idx", F.struct(F.col("player_tag").alias("tag"), F.struct(F.col("brawler_id").alias("id"), F.col("power").cast("int").alias("power"), F.col("trophies").cast("int").alias("trophies")).alias("brawler")).alias("p"))
    # Sent by match as plain rows: lists begun before the shuffle hold a row or two each, and are sorted and sent as objects.
    ps = bind.players(spark, sf).repartition("match_id").groupBy("match_id").agg(F.sort_array(F.collect_list(row)).alias("ps"))
    team = lambda k: F.transform(F.filter("ps", lambda x: x["team_idx"] == k), lambda x: x["p"])
    k = F.col("match_id") % 4
    result = F.when(k == 0, "victory").when(k == 1, "defeat").when(k == 2, "draw")
    df = bind.matches(spark, sf).join(ps, "match_id")
    battle = F.struct(F.col("mode"), F.col("battle_type").alias("type"), result.alias("result"), (F.col("c") % 17 - 8).cast("int").alias("trophyChange"), F.array(team(0), team(1)).alias("teams"))
    event = F.struct((F.col("map_id") + 0).alias("id"), F.when(F.col("match_id") % 3 != 0, F.col("mode")).otherwise("").alias("mode"), F.concat(F.lit("Map "), F.col("map_id").cast("string")).alias("map"))
    time = F.date_format(F.col("t").cast("timestamp"), "yyyyMMdd'T'HHmmss.'000Z'")
    tag = F.when(F.col("match_id") % 50 == 7, "#nobody").otherwise(F.element_at("ps", 1)["p"]["tag"])
    return df.select(F.to_json(F.struct(time.alias("battleTime"), event.alias("event"), battle.alias("battle"))).alias("item"), tag.alias("queried_tag"))


ITEMS = f"""{M}, {P}, g AS (SELECT match_id, count(*) AS n, count(DISTINCT player_tag) AS nd, count(*) FILTER (WHERE team_idx = 0) AS n0, count(*) FILTER (WHERE team_idx = 1) AS n1, string_agg(player_tag, ',' ORDER BY player_tag) AS tags,
 min(slot) AS s0 FROM p GROUP BY match_id), j AS (SELECT m.*, g.*, CASE WHEN n0 = 0 OR n1 = 0 THEN 'empty team' WHEN nd <> n THEN 'duplicate tag' WHEN m.match_id % 50 = 7 THEN 'not present' END AS reason FROM m JOIN g ON g.match_id = m.match_id)"""


@query(
    f"""WITH {ITEMS}, r AS (SELECT *, (s0 - 1) % 2 AS mine, CASE match_id % 4 WHEN 0 THEN 'victory' WHEN 1 THEN 'defeat' WHEN 2 THEN 'draw' END AS result, c % 17 - 8 AS ch FROM j WHERE reason IS NULL)
SELECT sha1(strftime(t, '%Y%m%dT%H%M%S.000Z') || '|' || tags) AS match_id, CASE WHEN battle_type IN ('soloRanked', 'teamRanked') THEN 1 ELSE 0 END AS is_ranked, mode AS event_mode, 'Map ' || map_id AS map_name, n0 AS team_size,
 CASE WHEN result = 'victory' THEN mine WHEN result = 'defeat' THEN 1 - mine WHEN result IS NULL AND ch > 0 THEN mine WHEN result IS NULL AND ch < 0 THEN 1 - mine END AS winning_team_idx FROM r"""
)
def normalize_matches(spark, sf):
    m = normalize.matches(normalize.parse(_items(spark, sf)))
    return m.select("match_id", "is_ranked", "event_mode", "map_name", F.col("team_size").cast("long").alias("team_size"), F.col("winning_team_idx").cast("long").alias("winning_team_idx"))


@query(f"WITH {ITEMS} SELECT reason, battle_type, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL")
def normalize_rejects(spark, sf):
    r = normalize.rejects(normalize.parse(_items(spark, sf)))
    return r.groupBy("reason", "battle_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEMS}, q AS (SELECT j.match_id, p.team_idx, p.brawler_id FROM j JOIN p ON p.match_id = j.match_id WHERE reason IS NULL) SELECT team_idx, brawler_id, count(*) AS n, count(DISTINCT match_id) AS n_matches FROM q GROUP BY ALL")
def normalize_participants(spark, sf):
    p = normalize.participants(normalize.matches(normalize.parse(_items(spark, sf))))
    # The digests are counted as bytes, which are half as long.
    return p.groupBy("team_idx", "brawler_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.unhex("match_id")).alias("n_matches"))


@query(f"WITH {M} SELECT battle_type, count(*) AS n FROM m WHERE battle_type NOT IN ('soloRanked', 'teamRanked') GROUP BY battle_type")
def type_collector(spark, sf):
    m = bind.matches(spark, sf)
    return m.where(~F.col("battle_type").isin(bind.RANKED)).groupBy("battle_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def srt_deoverlap(spark, sf):
    """Captions whose cues are the turns of a conversation, each with the end of the one before."""
    c = bind.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("n"), (F.col("turn") * 25).alias("start"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    rolled = textkb.cues(_as_srt(c))
    return textkb.without_overlap(rolled)


def _as_srt(c):
    time = lambda s: F.format_string("%02d:%02d:%02d,000", (s / 3600).cast("long"), (s / 60).cast("long") % 60, s % 60)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), time(F.col("start")), F.lit(" --> "), time(F.col("start") + 20), F.lit("\n"), "text")
    blocks = c.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("bs"))
    return blocks.select("path", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("text"))


@query("SELECT source AS page, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars % 3) AS BIGINT) AS score1, CAST(min(doc_id) AS BIGINT) AS first_date FROM documents GROUP BY source")
def wikitext_maps(spark, sf):
    part = F.concat(F.lit("{{Match|date="), F.col("doc_id").cast("string"), F.lit("\n}}{{MapVeto|x}}{{Map|map="), "lang", F.lit(" <!-- c -->|score1="), (F.col("n_chars") % 3).cast("string"), F.lit("|score2=0}}"))
    # A page of the wiki: the documents of one source, in chunks so that none grows without bound.
    docs = bind.table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    pages = docs.groupBy("source", F.floor(F.col("doc_id") / 500).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("m")))), lambda x: x["m"]), "").alias("text"))
    r = textkb.template_records(pages.select(F.col("source").alias("page"), "text").withColumn("page", F.concat_ws("\u0001", "page", F.xxhash64("text").cast("string"))))
    by = r.groupBy(F.split("page", "\u0001")[0].alias("page"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score1").cast("long")).alias("score1"), F.min(F.col("date").cast("long")).alias("first_date"))


@query("SELECT lang AS type, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(CASE WHEN coalesce(quality, -1) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS supported, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS inconclusive FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def claims_by_type(spark, sf):
    from trifold.operators.health import verdict

    d = bind.table(spark, sf, "documents").select("doc_id", "lang", "source").join(bind.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    v = d.withColumn("verdict", verdict(F.col("quality") == 1))
    n = lambda x: F.sum((F.col("verdict") == x).cast("long"))
    return v.groupBy(F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), n("SUPPORTED").alias("supported"), n("INCONCLUSIVE").alias("inconclusive"))


@query("SELECT 'distinct user_id' AS field, count(DISTINCT user_id) > 5 AS usable, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'distinct event_type', count(DISTINCT event_type) > 5, count(DISTINCT event_type) FROM events")
def quality_gate(spark, sf):
    e = bind.table(spark, sf, "events").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("event_type").alias("t"))
    row = lambda name, c: F.struct(F.lit(name).alias("field"), (F.col(c) > 5).alias("usable"), F.col(c).alias("n"))
    return e.select(F.explode(F.array(row("distinct user_id", "u"), row("distinct event_type", "t"))).alias("r")).select("r.*")


@query(
    """WITH c AS (SELECT coalesce(lang, 'und') AS type, coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL)
SELECT type, '{"type":"' || type || '","claims":' || CAST(sum(n) AS BIGINT) || ',"sources":[' || string_agg('{"source":"' || source || '","n":' || n || '}', ',' ORDER BY source) || ']}' AS document FROM c GROUP BY type"""
)
def claims_document(spark, sf):
    """The nested document of each type of claim, as JSON."""
    return textkb.documents(bind.table(spark, sf, "documents").select(F.coalesce("lang", F.lit("und")).alias("type"), F.coalesce("source", F.lit("")).alias("source")))


def _sound(x: str) -> str:
    out = f"translate(regexp_replace(replace({x}, 'ph', 'f'), '^(kn|gn)', 'n'), 'bcdgqvxz', 'pktkkfss')"
    for c in "fjklmnprst":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return f"replace(regexp_replace(regexp_replace({out}, '^[aeiou]+', 'A'), '[aeiouhwy]', '', 'g'), 'A', 'a')"


@query(
    f"""WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents WHERE text IS NOT NULL), tw AS (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1]))) AS word FROM t), w AS (SELECT word, count(*) AS n, {_sound('word')} AS key FROM tw GROUP BY word),
nm AS (SELECT name, min(p_partkey) AS name_id FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS name FROM part) WHERE name <> '' GROUP BY name), fm AS (SELECT DISTINCT name_id, unnest([name, name || 's', regexp_replace(name, 's$', '')]) AS form FROM nm), f AS (SELECT *, {_sound('form')} AS key FROM fm WHERE length(form) >= 3),
m AS (SELECT word, n, name_id, form, levenshtein(word, form) AS distance FROM w JOIN f USING (key) WHERE key <> '' AND word NOT IN (SELECT form FROM f)), k AS (SELECT * FROM m WHERE distance BETWEEN 1 AND least(2, length(form) // 3)),
r AS (SELECT *, min(distance) OVER (PARTITION BY word) AS d FROM k), b AS (SELECT word, any_value(n) AS n, min((form, name_id)) AS x, any_value(d) AS distance, count(DISTINCT name_id) AS n_names FROM r WHERE distance = d GROUP BY word)
SELECT word, n, x[2] AS name_id, x[1] AS form, CAST(distance AS INT) AS distance, n_names, n_names > 1 OR n >= 500 AS ambiguous FROM b"""
)
def misheard_names(spark, sf):
    """Words of all texts that sound like a word of the parts' names; those met 500 times or more are ordinary words."""
    words = misheard.caption_words(bind.table(spark, sf, "documents"))
    each = bind.table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("name")).where("name <> ''")
    names = misheard.forms(each.groupBy("name").agg(F.min("p_partkey").alias("id")), "id", "name")
    words = durable(words)
    return misheard.heard(words, names, words.where("n >= 500"))


_FIELD = """CASE WHEN regexp_matches({x}, '[",\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


@query(
    f"""WITH g AS (SELECT coalesce(source, '-') AS source, count(*) AS n, avg(n_chars) AS chars, coalesce(min(text), '') AS sample FROM documents GROUP BY ALL), s AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS share, 1 / CAST(count(*) OVER () AS DOUBLE) AS fair FROM g),
t AS (SELECT *, printf('%.1f%%', 100 * share) AS pct, CASE WHEN share >= fair THEN '+' ELSE '' END || printf('%.2fpp', 100 * (share - fair)) AS pp FROM s)
SELECT source, source || repeat(' ', greatest(20 - len(source), 0)) || repeat(' ', greatest(8 - len(pct), 0)) || pct AS line, {_FIELD.format(x='source')} || ',' || n || ',' || printf('%.3f', chars) || ',' || pp || ',' || {_FIELD.format(x='sample')} AS csv FROM t"""
)
def report_lines(spark, sf):
    """A report of the sources for readers and as CSV: share, distance from an equal share, and the text that sorts first, quoted where needed."""
    g = bind.table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(n_rows().alias("n"), F.avg("n_chars").alias("chars"), F.coalesce(F.min("text"), F.lit("")).alias("sample"))
    g = durable(g)  # a row a source
    s = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total"), n_rows().alias("sources"))))
    share = F.col("n") / F.col("total")
    line = F.concat(padded("source", 20), padded(percent(share), 8, right=True))
    return s.select("source", line.alias("line"), csv_line("source", "n", fixed("chars", 3), points(share - 1 / F.col("sources")), "sample").alias("csv"))
