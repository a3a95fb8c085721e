"""Domain views over the supplied tables: matches, players, drafts, the poll log, patches and scored rows.

Everything is integer arithmetic on the tables' own columns, so any SQL engine
can repeat it.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trifold.session import shared_folder

#: Bytes of pages that the page server reads at once.
PAGES_A_READ = 8 << 20
N = 107  # characters
RANKED = ["soloRanked", "teamRanked"]
CLASSES = ["damage", "controller", "assassin", "tank", "support", "marksman", "artillery"]
#: Half-open segments; the last is open.
PATCHES = [
    ("p1", "1995-01-01", "1995-09-01"), ("p2", "1995-09-01", "1996-05-01"), ("p3", "1996-05-01", "1997-01-01"), ("p4", "1997-01-01", "1997-09-01"),
    ("p5", "1997-09-01", "1998-06-01"), ("p6", "1998-06-01", "1999-06-01"), ("p7", "1999-06-01", "2000-09-01"), ("p8", "2000-09-01", None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("match_id"),
        F.col("o_orderdate").alias("t"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderpriority").alias("mode"),
        (F.col("o_custkey") % 30).cast("int").alias("map_id"),
        F.when(k % 5 == 0, "ranked").when(k % 5 == 4, "teamRanked").otherwise("soloRanked").alias("battle_type"),
        F.when(k % 17 == 0, 5).otherwise(3).alias("team_size"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("winning_team_idx"),
    )


def is_ranked(battle_type: str = "battle_type") -> Column:
    return F.col(battle_type).isin(RANKED).cast("int")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        ((F.col("l_linenumber") - 1) % 2).alias("team_idx"),
        F.col("l_linenumber").alias("slot"),
        (F.col("l_partkey") % N).cast("int").alias("brawler_id"),
        F.concat(F.lit("#"), F.col("l_suppkey").cast("string")).alias("player_tag"),
        F.col("l_suppkey").alias("player"),
        F.col("l_quantity").alias("power"),
        F.col("l_extendedprice").alias("trophies"),
    )


def _pick(a: int, b: int, c: int) -> Column:
    return ((F.col("match_id") * a + F.col("c") * b + c) % N).cast("int")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with two arrays of three picks, those without a repeated pick in a team; y is 1 if team 0 won."""
    m = matches(spark, sf_dir).withColumn("a", F.array(_pick(31, 17, 7), _pick(53, 29, 19), _pick(71, 43, 31)))
    m = m.withColumn("b", F.array(_pick(89, 61, 43), _pick(97, 73, 59), _pick(101, 83, 71)))
    m = m.where((F.size(F.array_distinct("a")) == 3) & (F.size(F.array_distinct("b")) == 3))
    return m.withColumn("y", F.when(F.col("winning_team_idx") == 0, 1).when(F.col("winning_team_idx") == 1, 0))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).where(F.col("y").isNotNull())


def hour(match_id: str = "match_id") -> Column:
    """The hour of day of a match; the tables' own times are dates."""
    return (F.col(match_id) * 13 + 5) % 24


#: What a map is like, each a number from -1 to 1.
TRAITS = ["open", "cover"]


def map_traits(map_id: str = "map_id") -> dict[str, Column]:
    """A column for each trait of a match's map."""
    m = F.col(map_id)
    return {"open": ((m * 7 + 3) % 11 - 5) / 5, "cover": ((m * 4 + 1) % 9 - 4) / 4}


def class_of(pick: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), (pick % len(CLASSES) + 1).cast("int"))


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"),
        F.col("user_id").alias("tag"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (k % 26).alias("new_matches"),
        F.col("value").alias("latency"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polled players: when they are due, how they rank, when they were last enriched."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("tag"),
        (k % 10 != 3).cast("int").alias("is_active"),
        F.when(k % 7 != 0, 1_000_000 + (k * 37) % 10_000).alias("next_poll_at"),
        F.round(F.col("c_acctbal") / 100, 2).alias("priority_score"),
        F.when(k % 4 != 1, 900_000 + (k * 91) % 100_000).alias("enriched_at"),
        F.when(k % 3 != 0, (k % 25).cast("int")).alias("ranked_rank"),
        F.col("c_nationkey").alias("region"),
    )


def patches(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PATCHES, "patch_id string, start_s string, end_s string")
    return rows.select("patch_id", F.col("start_s").cast("timestamp_ntz").alias("start"), F.col("end_s").cast("timestamp_ntz").alias("stop"))


def characters(spark: SparkSession) -> DataFrame:
    """The dimension of the N characters: id, class and name."""
    ids = spark.range(N).select(F.col("id").cast("int").alias("brawler_id"))
    return ids.select("brawler_id", class_of(F.col("brawler_id")).alias("class"), F.concat(F.lit("Unit "), F.col("brawler_id").cast("string")).alias("name"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a probability: id, y, p."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = 1 / (1 + F.exp(-((F.col("n_chars") % 1000) - 500) / 250))
    return q.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), p.alias("p"), (F.col("n_chars") % 1000).alias("score"))


def page_server(spark: SparkSession, sf_dir: str):
    """A transport that answers /pages/{page_id} from the table: 404 for one page in ten, and at first 503 for one in seven of the others.

    The server's own store has the pages in order, so a request reads one block of them, and the next ones mostly the same block."""
    store = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    pages.repartitionByRange("page_id").sortWithinPartitions("page_id").write.option("parquet.block.size", PAGES_A_READ).parquet(store)
    asked, blocks, held = set(), [], {}

    def get(path: str) -> tuple[int, str]:
        k = int(path.rsplit("/", 1)[1])
        if k % 10 == 3:
            return 404, ""
        if k % 7 == 1 and k not in asked:
            asked.add(k)
            return 503, ""
        if not blocks:
            blocks.extend(_blocks(store))
        at = bisect_right(blocks, k, key=lambda b: b[0]) - 1
        if at < 0 or blocks[at][1] < k:
            return 404, ""
        if held.get("at") != at:
            _, _, file, group = blocks[at]
            rows = file.read_row_group(group, columns=["page_id", "html"])
            held.update(at=at, ids=rows.column("page_id").to_numpy(), html=rows.column("html"))
        place = int(held["ids"].searchsorted(k))
        return (200, held["html"][place].as_py()) if held["ids"][place] == k else (404, "")

    return get


def _blocks(store: str) -> list:
    """Least and largest page_id, file and number of each row group of a store in the order of page_id."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(store) if ":" in store else (fs.LocalFileSystem(), store)
    out = []
    for found in files.get_file_info(fs.FileSelector(root)):
        if found.path.endswith(".parquet"):
            file = pq.ParquetFile(found.path, filesystem=files)
            for g in range(file.num_row_groups):
                ids = file.metadata.row_group(g).column(0).statistics
                out.append((ids.min, ids.max, file, g))
    return sorted(out, key=lambda b: b[:2])
