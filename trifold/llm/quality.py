"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes run over overlapping chunks of CHUNK
bytes that cover the whole text; each filter's response is kept at its maximum
in a chunk.  A document's features are the mean and the maximum over its chunks,
and a logistic layer makes one probability of them.

The network is trained on at most SAMPLE labelled documents of each label,
those with the smallest hashes of their doc_id, so that the sample is bounded
and the same on every run; none has more than LONGEST bytes.  Some are shown in short pieces besides.  Scores read nothing but the text.  Where a label is
missing altogether, the score is the share of label 1 (0.5 without labels).

Defined cases: a null text counts as empty, and an empty text is one chunk of
padding; null labels are left out; of several labels for a doc_id the smaller
counts; repeated rows get equal scores; an empty table gives no rows; texts of
any length are scored in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, held_out, table, utf8

FILTERS, WIDTH, CHUNK, STEP = 8, 5, 256, 224
SAMPLE, EPOCHS, RATE, SEED = 800, 14, 0.01, 7
#: Share of the sample that is also shown as a piece of so many bytes, so that short texts are known too.
CROPS, CROP = 0.3, (20, 120)
THRESHOLD = 0.3
#: Longer texts aren't in the sample that is learned from.
LONGEST = 1 << 18


class Net:
    """table: a filter's weight for each place and byte; out: the logistic layer."""

    def __init__(self, rng: np.random.Generator):
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Of every place in ``raw``, which is padded to WIDTH bytes at least."""
        if len(raw) < WIDTH:
            raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
        n = len(raw) - WIDTH + 1
        out = self.table[0].take(raw[:n], axis=0)
        for j in range(1, WIDTH):
            out += self.table[j].take(raw[j : j + n], axis=0)
        return out

    def pooled(self, raw: np.ndarray, most: int = STEP * 1024) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maxima and where they are; done in slices of ``most`` places."""
        tops, places = [], []
        n = max(1, len(raw) - WIDTH + 1)
        for a in range(0, n, most):
            r = self.responses(raw[a : a + most + CHUNK - STEP + WIDTH - 1])
            starts = np.arange(0, min(most, max(1, len(r) - (CHUNK - STEP) if a or len(r) > CHUNK else 1)), STEP)
            full = starts[starts + CHUNK <= len(r)]
            if len(full):
                view = np.lib.stride_tricks.as_strided(r, (len(full), CHUNK, FILTERS), (STEP * r.strides[0], *r.strides))
                top = view.argmax(axis=1)
                tops.append(np.take_along_axis(view, top[:, None, :], axis=1)[:, 0])
                places.append(top + full[:, None] + a)
            for s in starts[len(full) :]:
                top = r[s : s + CHUNK].argmax(axis=0)
                tops.append(r[s + top, np.arange(FILTERS)][None])
                places.append((top + s + a)[None])
        return np.concatenate(tops), np.concatenate(places)

    def features(self, tops: np.ndarray) -> np.ndarray:
        act = np.tanh(tops + self.bias)
        return np.concatenate([act.mean(axis=0), act.max(axis=0)])

    def score(self, raw: np.ndarray) -> float:
        z = float(self.features(self.pooled(raw)[0]) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: list[int], weights: tuple[float, float]) -> Net:
    """Gradient steps with running second moments, one document at a time in a fixed shuffled order."""
    rng = np.random.default_rng(SEED)
    net = Net(rng)
    raws, labels = [np.frombuffer(t, np.uint8) for t in texts], list(labels)
    for i in np.flatnonzero(rng.random(len(raws)) < CROPS):
        n = int(rng.integers(*CROP))
        if len(raws[i]) > n:
            at = int(rng.integers(0, len(raws[i]) - n))
            raws.append(raws[i][at : at + n])
            labels.append(labels[i])
    cells = np.arange(FILTERS)
    square = {k: np.full_like(getattr(net, k), 1e-4) for k in ("table", "bias", "out")}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(raws)):
            raw, y = raws[i], labels[i]
            if len(raw) < WIDTH:
                raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
            tops, places = net.pooled(raw)
            act = np.tanh(tops + net.bias)
            best = act.argmax(axis=0)
            x = np.concatenate([act.mean(axis=0), act[best, cells]])
            p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -30, 30)))
            g = np.float32((p - y) * weights[y])
            back = np.tile(g * net.out[:FILTERS] / len(act), (len(act), 1))
            back[best, cells] += g * net.out[FILTERS:]
            back *= 1 - act * act
            grads = {"out": g * x + np.float32(1e-4) * net.out, "bias": back.sum(axis=0)}
            for k, d in grads.items():
                square[k] += (d * d - square[k]) * 0.01
                getattr(net, k)[...] -= rate * d / np.sqrt(square[k] + 1e-8)
            net.out_bias -= np.float32(rate * g)
            for j in range(WIDTH):
                at = (j, raw[places + j], cells[None, :])
                d = np.zeros((256, FILTERS), np.float32)
                np.add.at(d, at[1:], back)
                square["table"][j] += (d * d - square["table"][j]) * 0.01
                net.table[j] -= rate * d / np.sqrt(square["table"][j] + 1e-5)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net | float:
    """The network, or a constant score where only one label or none is known."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    count = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(count.values())
    if not (count.get(0) and count.get(1)):
        return count.get(1, 0) / total if total else 0.5
    picked = [known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x sample ids at most
    rows = docs.select("doc_id", "text").join(picked, "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:  # texts of one label at most
        return count[1] / total
    got = [max(1, sum(r["quality"] == y for r in rows)) for y in (0, 1)]
    weights = tuple(len(rows) * count[y] / total / got[y] for y in (0, 1))  # the labels' shares among all
    return train([(r["text"] or "").encode() for r in rows], [r["quality"] for r in rows], weights)


def _score(net):
    def run(batches):
        model = net.value
        for batch in chunks(batches, "text"):
            raw, offs = utf8(batch.column("text"))
            score = [model if isinstance(model, float) else model.score(raw[a:b]) for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def scores(docs: DataFrame, net: Net | float) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(net if isinstance(net, Net) else float(net))
    return docs.select("doc_id", "text").mapInArrow(_score(held), "doc_id long, text string, score double").select("doc_id", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    plain = docs.toDF(*[n if n == "text" else f"c{k}" for k, n in enumerate(names)])  # a column may already be called score
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(_score(held), f"{schema}, score double").where(F.col("score") >= threshold).drop("score").toDF(*names)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
