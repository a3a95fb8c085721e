"""The bindings of ``trifold.sources.bind`` as SQL views, for the oracle's common table expressions."""

M = """m AS (SELECT o_orderkey AS match_id, o_orderdate AS t, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_custkey AS c, o_orderpriority AS mode,
 CAST(o_custkey % 30 AS INT) AS map_id, CASE o_orderkey % 5 WHEN 0 THEN 'ranked' WHEN 4 THEN 'teamRanked' ELSE 'soloRanked' END AS battle_type,
 CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 3 END AS team_size, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS winning_team_idx FROM orders)"""

P = """p AS (SELECT l_orderkey AS match_id, (l_linenumber - 1) % 2 AS team_idx, l_linenumber AS slot, CAST(l_partkey % 107 AS INT) AS brawler_id,
 '#' || l_suppkey AS player_tag, l_suppkey AS player, l_quantity AS power, l_extendedprice AS trophies FROM lineitem)"""

D = (
    M
    + """, d0 AS (SELECT *, [(31 * match_id + 17 * c + 7) % 107, (53 * match_id + 29 * c + 19) % 107, (71 * match_id + 43 * c + 31) % 107] AS a,
 [(89 * match_id + 61 * c + 43) % 107, (97 * match_id + 73 * c + 59) % 107, (101 * match_id + 83 * c + 71) % 107] AS b FROM m),
d AS (SELECT *, CASE winning_team_idx WHEN 0 THEN 1 WHEN 1 THEN 0 END AS y FROM d0 WHERE len(list_distinct(a)) = 3 AND len(list_distinct(b)) = 3)"""
)

#: Two rows per decided draft.
S = (
    D
    + """, s AS (SELECT match_id, mode, map_id, t, 0 AS side, a AS team, b AS other, y AS won FROM d WHERE y IS NOT NULL
 UNION ALL SELECT match_id, mode, map_id, t, 1, b, a, 1 - y FROM d WHERE y IS NOT NULL)"""
)

L = """l AS (SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, user_id AS tag, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
 CAST(json_extract_string(props, '$.k') AS INT) % 26 AS new_matches, value AS latency FROM events)"""

POOL = """pool AS (SELECT c_custkey AS tag, CASE WHEN c_custkey % 10 <> 3 THEN 1 ELSE 0 END AS is_active, CASE WHEN c_custkey % 7 <> 0 THEN 1000000 + (c_custkey * 37) % 10000 END AS next_poll_at,
 round(c_acctbal / 100, 2) AS priority_score, CASE WHEN c_custkey % 4 <> 1 THEN 900000 + (c_custkey * 91) % 100000 END AS enriched_at,
 CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 25 AS INT) END AS ranked_rank, c_nationkey AS region FROM customer)"""

PATCH = """patch(patch_id, start, stop) AS (VALUES ('p1', TIMESTAMP '1995-01-01', TIMESTAMP '1995-09-01'), ('p2', TIMESTAMP '1995-09-01', TIMESTAMP '1996-05-01'), ('p3', TIMESTAMP '1996-05-01', TIMESTAMP '1997-01-01'),
 ('p4', TIMESTAMP '1997-01-01', TIMESTAMP '1997-09-01'), ('p5', TIMESTAMP '1997-09-01', TIMESTAMP '1998-06-01'), ('p6', TIMESTAMP '1998-06-01', TIMESTAMP '1999-06-01'),
 ('p7', TIMESTAMP '1999-06-01', TIMESTAMP '2000-09-01'), ('p8', TIMESTAMP '2000-09-01', NULL))"""

SC = """sc AS (SELECT l.doc_id AS id, quality AS y, 1 / (1 + exp(-((n_chars % 1000) - 500) / 250.0)) AS p, n_chars % 1000 AS score FROM labels l JOIN documents USING (doc_id))"""

CLASS = "['damage', 'controller', 'assassin', 'tank', 'support', 'marksman', 'artillery']"
SHORT = "['dam', 'con', 'ass', 'tan', 'sup', 'mar', 'art']"


def wilson(k: str, n: str) -> tuple[str, str]:
    centre = f"(({k}) / CAST({n} AS DOUBLE) + 3.8416 / (2 * {n}))"
    half = f"1.96 * sqrt(({k}) / CAST({n} AS DOUBLE) * (1 - ({k}) / CAST({n} AS DOUBLE)) / {n} + 3.8416 / (4.0 * {n} * {n}))"
    return f"greatest(({centre} - {half}) / (1 + 3.8416 / {n}), 0)", f"least(({centre} + {half}) / (1 + 3.8416 / {n}), 1)"
