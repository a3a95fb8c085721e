"""Spelling variants grouped by pivotal grams.

Words that differ by one edit share all their bigrams but those that the edit
touches.  Among a word's EDITS * 2 + 1 rarest bigrams, dynamic programming chooses
its pivots, EDITS + 1 disjoint ones of the least total frequency; its prefix holds
these rarest ones and a few more that equal the last of them.  One edit spoils one
pivot at most, so of two near words one's pivot stands in the other's prefix,
and the edit is on one side of it.  That limits positions: either the
bigram and its side up to BESIDE code points beyond it are equal, or the edit
is within these BESIDE code points, and the bigram's other side and what follows
them are.  Keys hold the equal parts, so words meet in an equality join, and
their edit distance is verified.

Words are few beside their occurrences: occurrences are counted with a partial
aggregate before any shuffle, and each word is joined once.  A word has a few
thousand near words at most, for its alphabet is bounded, and so is the table of
bigrams that is broadcast (90 letters, 8100 pairs of them).

Defined cases: a null text has no words; a null doc_id counts as an empty one
in the hash; words of repeated rows count as often as they stand; an empty
table, or one without words, gives no rows; of near words with equally many
occurrences the smallest in code-point order is the form; other columns are left
alone.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Runs of letters; the least length and occurrences of a word; how many times more often its form stands.
LETTERS, LEAST_LENGTH, LEAST_N, TIMES = "a-zÀ-ÿ", 7, 2, 10
#: One run in DAMAGE, by hash, lacks a letter.
DAMAGE = 31
GRAM, EDITS, BESIDE = 2, 1, 4


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per run of a whole text, ``word`` with the letter deleted that the hash of document and run names."""
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), 0)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n, of the words that are long and frequent enough."""
    rows = occurrences(docs).where(F.char_length("word") >= LEAST_LENGTH)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_N)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the words; there are 8100 at most."""
    at = F.sequence(F.lit(1), F.char_length("word") - GRAM + 1)
    grams = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("g"))
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}


def pivots(cost: list[int], places: list[int], k: int = EDITS + 1) -> list[int]:
    """``k`` of ``places``, at least GRAM apart, whose costs have the least sum; by dynamic programming over places in order.

    cost: of the bigram at each position.  None if there are no k disjoint ones."""
    places = sorted(places)
    # best[j]: (sum, chosen) of j disjoint bigrams among the places so far; ahead[i]: the places at least GRAM before the i-th.
    best: list[list[tuple | None]] = [[(0, ())] + [None] * k]
    ahead = 0
    for i, p in enumerate(places):
        while places[ahead] <= p - GRAM:
            ahead += 1
        now = list(best[i])
        for j in range(1, k + 1):
            if (was := best[ahead][j - 1]) is not None:
                new = (was[0] + cost[p], (*was[1], p))
                now[j] = new if now[j] is None else min(now[j], new)
        best.append(now)
    return list(best[-1][k][1]) if best[-1][k] else None


def prefix_of(rank: list[int], size: int = GRAM * EDITS + 1) -> tuple[list[int], list[int]]:
    """Positions of the ``size`` rarest bigrams, the first of equal ones; and these with the next GRAM * EDITS
    of the last one's, and so many that ``size`` of it are there.  rank: of each position's bigram.

    An edit makes GRAM * EDITS bigrams at most, so a bigram that is among another
    word's rarest stands among the latter here, whatever the edit put ahead of it."""
    order = sorted(range(len(rank)), key=lambda i: (rank[i], i))
    last = rank[order[size - 1]]
    less = [i for i in order[:size] if rank[i] < last]
    equal = [i for i in order[len(less) : len(less) + size + GRAM * EDITS] if rank[i] == last]
    return order[:size], less + equal


_INTS = pa.list_(pa.int32())


def _chosen(held):
    def run(batches):
        n_of, rank_of = held.value
        for batch in batches:
            prefix, chosen = [], []
            for w in batch.column("word").to_pylist():
                grams = [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]
                rarest, wide = prefix_of([rank_of[g] for g in grams])
                prefix.append(wide)
                chosen.append(pivots([n_of[g] for g in grams], rarest))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(chosen, _INTS), pa.array(prefix, _INTS)], names=["word", "n", "pivots", "prefix"])

    return run


def chosen(words: DataFrame) -> DataFrame:
    """word, n, and the positions of its pivots and of its prefix, both from 0."""
    n_of = gram_counts(words)
    rank_of = {g: k for k, (_, g) in enumerate(sorted((n, g) for g, n in n_of.items()))}
    held = words.sparkSession.sparkContext.broadcast((n_of, rank_of))
    return words.select("word", "n").mapInArrow(_chosen(held), "word string, n long, pivots array<int>, prefix array<int>")


def keys(p: Column, longer: int) -> list[Column]:
    """Keys of the word whose bigram at ``p`` is shared with another one, as that one has them if the word is ``longer`` by so much."""
    w, size = F.col("word"), F.char_length("word")
    right, left = p + (GRAM + BESIDE), p - BESIDE
    of = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    begin = lambda n: F.substring(w, F.lit(1), F.greatest(n, F.lit(0)))
    rest = lambda at: F.substring(w, at + 1, size)
    near_right = of(2, begin(p + GRAM), rest(right + longer), size - longer)
    near_left = of(4, rest(p), begin(left - longer), size - longer)
    if longer:
        return [near_right, near_left]
    return [near_right, near_left, F.when(size >= right, of(1, begin(right))), F.when(left >= 0, of(3, rest(left)))]


def _keyed(rows: DataFrame, places: str, longer: tuple[int, ...], word: str, n: str) -> DataFrame:
    every = F.flatten(F.transform(places, lambda p: F.array(*[k for d in longer for k in keys(p, d)])))
    return rows.select(F.explode(F.array_distinct(every)).alias("key"), F.col("word").alias(word), F.col("n").alias(n)).where("key IS NOT NULL")


def near(words: DataFrame) -> DataFrame:
    """Pairs of near words, each once: a < b with their numbers n_a and n_b; words: word and n, each word once."""
    rows = durable(chosen(words))
    one = _keyed(rows, "pivots", (0,), "v", "n_v")
    other = _keyed(rows, "prefix", tuple(range(-EDITS, EDITS + 1)), "w", "n_w")
    met = one.join(other.hint("merge"), "key").where((F.col("v") != F.col("w")) & (F.levenshtein("v", "w", EDITS) == EDITS))
    first = F.col("v") < F.col("w")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return met.select(pick("v", "w").alias("a"), pick("w", "v").alias("b"), pick("n_v", "n_w").alias("n_a"), pick("n_w", "n_v").alias("n_b")).distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best")
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    out = words.join(found, "word", "left")
    much = -F.col("best.neg") >= TIMES * F.col("n")
    form, form_n = (F.when(much, x) for x in (F.col("best.near"), -F.col("best.neg")))
    out = durable(out.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")))
    # Each step to a form multiplies n by TIMES at least, which bounds the steps; each round doubles those taken.
    most = out.agg(F.max("n")).first()[0] or 1
    links = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log(most, TIMES)))) if most > 1 else 0):
        links = durable(links)
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    out = out.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(docs: DataFrame) -> DataFrame:
    """The words of all texts with their forms and roots."""
    words = durable(vocabulary(docs.select("doc_id", "text")))
    return forms(words, near(words))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


#: crc32 by half bytes.  Its table of 16 entries is the polynomial 0xEDB88320 shifted four times.
ORACLE = {
    "op11_spelling": r"""
WITH t(t) AS (SELECT list_transform(range(16), lambda x: list_reduce(list_prepend(CAST(x AS BIGINT), [CAST(0 AS BIGINT), 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
d AS (SELECT run, hex(id || ':' || run) AS h, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, list_transform(range(length(h)), lambda i: CAST(strpos('0123456789ABCDEF', substr(h, CAST(i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END AS BIGINT), 1)) - 1 AS BIGINT)) AS nibbles FROM d),
c AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), nibbles), lambda c, x: xor(c // 16, t[xor(c, x) % 16 + 1])), 4294967295) AS h FROM b, t),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM k),
p AS (SELECT x.word AS a, x.n AS n_a, y.word AS b, y.n AS n_b FROM v x JOIN v y ON x.hole = y.hole AND x.word <> y.word
 UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.cut = w.word),
f AS (SELECT a, count(*) AS n_near, first(b ORDER BY n_b DESC, b) AS b, max(n_b) AS n_b FROM p GROUP BY a),
l AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= 10 * w.n THEN b END AS form, CASE WHEN n_b >= 10 * w.n THEN n_b END AS form_n FROM w LEFT JOIN f ON f.a = w.word),
z AS (WITH RECURSIVE s(word, root) AS (SELECT word, form FROM l WHERE form IS NOT NULL UNION ALL SELECT s.word, l.form FROM s JOIN l ON l.word = s.root WHERE l.form IS NOT NULL)
 SELECT word, first(s.root ORDER BY m.n DESC) AS root FROM s JOIN (SELECT word AS root, n FROM w) m ON m.root = s.root GROUP BY word)
SELECT l.word, form, coalesce(root, l.word) AS root, l.n, n_near, form_n FROM l LEFT JOIN z ON z.word = l.word""",
}
