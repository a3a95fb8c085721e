"""Language identification of mixed-language text.

Each word's script, read off the ranges of its UTF-8 lead bytes, narrows the
candidates to the languages that were seen in it; any other one is out, whatever
its score.  Each candidate scores the
word by its byte trigrams, and Viterbi's algorithm with a switching penalty
labels the words, so a text falls into spans of one language each.  The
predicted language has most letters; the score is its share of them.

The model is fitted on at most SAMPLE documents of each language, those with
the smallest hashes of their doc_id among those of LONGEST bytes at most; whole
texts, nothing else of a document.  A language without a letter in them is not
learned, and so never predicted.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
so is every text if no language could be learned; null languages are never
learned, and null doc_ids neither; words of a script that no language was seen in fit all alike; a text whose letters form no word gets the most frequent language and
score 0; ties go to the language that sorts first; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, held_out, table, utf8, word_spans

SAMPLE, PENALTY, SMOOTHING, BUCKETS = 400, 6.0, 0.2, 1 << 16
#: Longer texts aren't in the sample that is learned from; words that Viterbi takes at once of a text.
LONGEST, BLOCK = 1 << 18, 512
LETTER = regex.compile(r"\p{L}")

#: First lead byte and script of the ranges in UTF-8 order.  Fixed values.
SCRIPTS = [
    (0x00, "latin"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD4, "armenian"), (0xD6, "hebrew"),
    (0xD8, "arabic"), (0xDC, "other"), (0xE0, "indic"), (0xE1, "other"), (0xE3, "kana"),
    (0xE4, "han"), (0xEA, "hangul"), (0xEE, "other"),
]
_SCRIPT = np.zeros(256, np.uint8)
for _k, (_lead, _) in enumerate(SCRIPTS):
    _SCRIPT[_lead:] = _k
_SCRIPT[0x80:0xC0] = 0  # continuation bytes

_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_IS_LETTER = _LOWER != 0x20


def letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of letters, lower-case where ASCII; all others as blanks, signs and punctuation beyond ASCII too."""
    out = _LOWER[raw]
    for lead, second, size in ((0xC2, (0x80, 0xBF), 2), (0xE2, (0x80, 0xAF), 3), (0xE3, (0x80, 0x80), 3), (0xEF, (0xBC, 0xBC), 3), (0xF0, (0x9F, 0x9F), 4)):
        at = np.flatnonzero(raw == lead)
        at = at[at + size <= len(raw)]
        at = at[(raw[at + 1] >= second[0]) & (raw[at + 1] <= second[1])]
        for j in range(size):
            out[at + j] = 0x20
    return out


def trigrams(low: np.ndarray) -> np.ndarray:
    """Bucket of each byte with its two neighbours."""
    b = np.concatenate([[0x20], low, [0x20]]).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E5) + b[1:-1] * np.uint32(0x1F35B) + b[2:] * np.uint32(0x3D)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


class Model:
    """langs in order; table: log-probability of each bucket by language; allowed: of scripts by languages."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray, common: int):
        self.langs, self.table, self.allowed, self.common = langs, table, allowed, common

    def words(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, first word of each text, and every word's scores by language."""
        low = letters(raw)
        starts, ends, first = word_spans(low, offs, _IS_LETTER)
        if not len(starts):
            return starts, ends, first, np.zeros((0, len(self.langs)), np.float32)
        # A text's first and last letters have blanks beside them.
        gram = trigrams(low)
        edge = offs[(offs > 0) & (offs < len(low))]
        for at, side in ((edge, 0), (edge - 1, 2)):
            near = [np.where(at + d >= 0, low[np.clip(at + d, 0, len(low) - 1)], 0x20) for d in (-1, 0, 1)]
            near[side] = np.full(len(at), 0x20, np.uint8)
            gram[at] = trigrams_of(*near)
        score = np.add.reduceat(self.table[gram] * (low != 0x20)[:, None], starts, axis=0)
        script = np.maximum.reduceat(np.where(low != 0x20, _SCRIPT[raw], 0), starts)
        known = self.allowed[script]
        score = np.where(known, score, -np.inf)  # no other word's score outweighs it
        score[~known.any(axis=1)] = 0
        return starts, ends, first, score.astype(np.float32)


def trigrams_of(a, b, c):
    a, b, c = (x.astype(np.uint32) for x in (a, b, c))
    return ((a * np.uint32(0x9E5) + b * np.uint32(0x1F35B) + c * np.uint32(0x3D)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _entries(score, begin, opens, penalty, block):
    """Forward values ahead of each block: 0 ahead of a text's first one, else by the max-plus
    products of the blocks before it, all of which are full."""
    n, langs = len(begin), score.shape[1]
    entry = np.zeros((n, langs))
    inner = np.flatnonzero(~opens) - 1  # blocks that have another one after them
    if not len(inner):
        return entry
    through = np.full((len(inner), langs, langs), -np.inf)
    through[:, np.arange(langs), np.arange(langs)] = 0
    for t in range(block):
        best = through.max(axis=2, keepdims=True)
        through = np.maximum(through, best - penalty) + score[begin[inner] + t][:, None, :]
    place = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))  # which block of its text
    order = np.argsort(place[inner], kind="stable")
    for i in np.split(order, np.flatnonzero(np.diff(place[inner][order])) + 1):
        value = (entry[inner[i]][:, :, None] + through[i]).max(axis=1)
        entry[inner[i] + 1] = value - value.max(axis=1, keepdims=True)
    return entry


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY, block: int = BLOCK) -> np.ndarray:
    """The best label of every word.

    Texts are cut into blocks of ``block`` words, and all blocks take their steps
    together: a long text takes no more steps than a short one.  Values enter a
    block through max-plus products, labels leave it through the map from its
    last label to the one before its first."""
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    size = np.diff(first)
    blocks = -(-size // block)
    text = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[:-1][text] + place * block
    length = np.minimum(size[text] - place * block, block)
    opens = place == 0
    value = _entries(score, begin, opens, penalty, block)
    order = np.argsort(-length, kind="stable")  # the longest first
    active = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")  # blocks that have a step t
    moved, source = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    for t, k in enumerate(active):
        who = order[:k]
        at, now = begin[who] + t, value[who]
        best = now.argmax(axis=1)
        switch = now[np.arange(k), best] - penalty
        move = now < switch[:, None]
        moved[at], source[at] = move, best
        now = np.where(move, switch[:, None], now) + score[at]
        value[who] = now - now.max(axis=1, keepdims=True)
    end = value.argmax(axis=1)
    inner = np.flatnonzero(~opens)
    if len(inner):  # the label before each such block, for every label that it may end with
        before = np.tile(np.arange(score.shape[1]), (len(inner), 1))
        for t in range(int(length[inner].max()) - 1, -1, -1):
            i = np.flatnonzero(length[inner] > t)
            at = begin[inner[i]] + t
            before[i] = np.where(np.take_along_axis(moved[at], before[i], axis=1), source[at][:, None], before[i])
        for i in range(len(inner) - 1, -1, -1):
            end[inner[i] - 1] = before[i, end[inner[i]]]
    for t in range(len(active) - 1, -1, -1):
        who = order[: active[t]]
        at, now = begin[who] + t, end[who]
        label[at] = now
        end[who] = np.where(moved[at, now], source[at], now)
    return label


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from text and lang of the documents given."""
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= LONGEST)
    docs = docs.where(usable)
    known = docs.select("doc_id", "lang")
    langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not langs:
        return None
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Only a part of the hash range, in which each language has its sample and more, is ranked.
    part = known.withColumn("n", F.create_map(*[F.lit(x) for kv in langs.items() for x in kv])[F.col("lang")])
    part = part.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("n") < F.lit(4 * sample * (1 << 20)))
    picked = part.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang").distinct()
    # One text for each picked document, however often its doc_id is repeated.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    names = sorted(langs)
    counts = np.full((BUCKETS, len(names)), SMOOTHING, np.float64)
    scripts = np.zeros((len(SCRIPTS), len(names)))
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        k = names.index(r["lang"])
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        low = letters(raw)
        counts[:, k] += np.bincount(trigrams(low)[low != 0x20], minlength=BUCKETS)
        scripts[:, k] += np.bincount(_SCRIPT[raw][(low != 0x20) & ((raw < 0x80) | (raw >= 0xC0))], minlength=len(SCRIPTS))
    learned = np.flatnonzero(scripts.sum(axis=0))
    if not len(learned):
        return None
    names, counts, scripts = [names[k] for k in learned], counts[:, learned], scripts[:, learned]
    allowed = scripts > 0.01 * np.maximum(scripts.sum(axis=0), 1)
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(names, table, allowed, names.index(max(names, key=langs.get)))


LABELS = "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _label(held):
    def run(batches):
        model = held.value
        for batch in chunks(batches, "text", 1 << 23):
            raw, offs = utf8(batch.column("text"))
            texts = batch.column("text").to_pylist()
            n = batch.num_rows
            pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if model is not None and len(raw):
                parts, at = [], 0
                while at < n:  # the bytes in smaller parts, the words all together
                    to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1)
                    a, b, f, s = model.words(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
                    parts.append((a + offs[at], b + offs[at], np.diff(f), s))
                    at = to
                starts, ends, sizes, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                first = np.concatenate([[0], np.cumsum(sizes)])
                label = viterbi(scores, first)
                doc = np.repeat(np.arange(n), sizes)
                mass = np.zeros((n, len(model.langs)))
                np.add.at(mass, (doc, label), ends - starts)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                i = np.flatnonzero(new)
                j = np.append(i[1:], len(doc)) - 1
                for d, a, b, k in zip(doc[i].tolist(), points[starts[i]].tolist(), points[ends[j]].tolist(), label[i].tolist(), strict=True) if len(i) else ():
                    base = int(points[offs[d]])
                    spans[d].append({"start": a - base, "end": b - base, "lang": model.langs[k]})
                for d in range(n):
                    if sizes[d]:
                        k = int(mass[d].argmax())
                        pred[d], score[d] = model.langs[k], float(mass[d, k] / mass[d].sum())
                    else:
                        pred[d] = model.langs[model.common]
                    if not LETTER.search(texts[d]):
                        pred[d], score[d], spans[d] = "und", 0.0, []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and spans (code points, end exclusive) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_label(held), LABELS)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = label(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
