"""Personal data by a skip-chain conditional random field.

Patterns give the base spans.  The field labels every candidate of a document,
that is every stretch that looks like an address or a long number, in order:
each candidate has a potential from its shape, neighbours share a chain
potential, and candidates with the same key share a skip potential, however far
apart.  A key is the address in lower case, or the digits of a number; a number
whose digits end another one of the document has that one's key.  Loopy message
passing makes labels consistent over the document, so a number that is written
once in full and then in looser or shorter forms is found every time, and so is
a card that stands beside another number.  Base spans are evidence and stay; the
field only adds spans.

A repeated key has a variable of its own, its hub, which every occurrence has a
skip link to, so links stay linear and none is far from another.  A base span
shows what its key is, so the hub holds the labels of its base spans and no
number of loose occurrences outvotes them.  All potentials are learned together
from the base spans of at most SAMPLE documents of LONGEST bytes at most, those
with the smallest hashes of their doc_id among those that have a candidate.  The
base shows no loose forms, so each base span with marks is shown without them
too, as itself and as another number.

Defined cases: a null text counts as empty and has no spans; without a sample
the field adds nothing; repeated rows get equal results; an empty table gives
no rows; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

KINDS = ["email", "ip", "card", "phone"]
SAMPLE, SURE = 1000, 0.8
#: Longer texts aren't in the sample that is learned from.
LONGEST = 1 << 18
#: Gradient steps of the fit, their rate and its penalties; neighbours are few, so the chain has its own.
STEPS, RATE, DECAY, CHAIN_DECAY = 3000, 1.0, 1e-5, 1e-2
#: Digits of a candidate at least, of any kind at most, and of a part that stands for itself.
LEAST_DIGITS, MOST_DIGITS, LONG_PART = 7, 19, 12
#: Messages are passed until none changes; damping grows after each ROUNDS rounds, so that they settle in any case.
ROUNDS = 100

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number part begins where no digit stands before it; possessive, so that long runs take linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,}+")
_PART = re.compile(r"[^ ]+")
_SIGN = re.compile(r"[0-9@]")
Span = tuple[int, int]
#: Which features are marks that the kinds' patterns ask for, rather than what is written.
MARKS = np.array([0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], bool)


def _emails(text: str) -> list[Span]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost matches of each kind that pass its test."""
    if not _SIGN.search(text):
        return {k: [] for k in KINDS}
    found = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


class Candidates:
    """Candidates of a text in order: spans, keys, features and the base label (0: none, else kind + 1)."""

    def __init__(self, text: str, base: dict[str, list[Span]]):
        spans = {s: k + 1 for k, kind in enumerate(KINDS) for s in base[kind]}
        taken = sorted(spans)
        # A loose candidate that touches a base span is the same thing.
        starts = np.array([s[0] for s in taken], np.int64)
        reach = np.maximum.accumulate(np.array([s[1] for s in taken], np.int64)) if taken else starts
        for a, b in [*self._numbers(text), *self._addresses(text)]:
            i = int(np.searchsorted(starts, b)) - 1
            if i < 0 or reach[i] <= a:
                spans.setdefault((a, b), 0)
        self.spans = sorted(spans)
        self.base = [spans[s] for s in self.spans]
        words = [text[a:b] for a, b in self.spans]
        self.keys = self._keys(words)
        self.features = np.array([self._shape(w) for w in words], np.float64) if words else np.zeros((0, 12))

    @staticmethod
    def _numbers(text: str) -> list[Span]:
        """Long numbers; where blanks part one that is long by itself from others, the long parts."""
        out = []
        for m in _NUMBER.finditer(text):
            parts = [(p.start() + m.start(), p.end() + m.start(), len(_digits(p.group()))) for p in _PART.finditer(m.group())]
            if len(parts) > 1 and max(n for _, _, n in parts) >= LONG_PART:
                out += [(a, b) for a, b, n in parts if n >= LEAST_DIGITS]
            else:
                out.append(m.span())
        return out

    @staticmethod
    def _addresses(text: str) -> list[Span]:
        """Whole stretches without white space around a sign, less the punctuation at their ends."""
        out, at = [], text.find("@")
        while at >= 0:
            a, b = at, at + 1
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            next_at = b
            while b > at + 1 and text[b - 1] in ".,;:!?)>\"'":
                b -= 1
            out.append((a, b))
            at = text.find("@", next_at)
        return out

    @staticmethod
    def _keys(words: list[str]) -> list[str]:
        """Addresses in lower case; of numbers the digits, or those of the longest number that ends with them."""
        keys = [w.lower() if "@" in w else _digits(w) for w in words]
        whole: dict[str, str] = {}
        for k in sorted({k for k in keys if "@" not in k and len(k) <= MOST_DIGITS}, key=lambda k: (-len(k), k)):
            for n in range(LEAST_DIGITS, len(k)):
                whole.setdefault(k[-n:], k)
        return [whole.get(k, k) for k in keys]

    @staticmethod
    def _shape(w: str) -> list[float]:
        d, n = _digits(w), len(_digits(w))
        return [1, "@" in w, "@" in w and "." in w[w.find("@") :], w.count(".") == 3, w[0] == "+", "(" in w, "-" in w, n <= 7, 8 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, "@" not in w and luhn(d)]

    def hubs(self) -> tuple[np.ndarray, int]:
        """Pairs of a candidate with a repeated key and the number of the key's hub, and how many hubs there are."""
        at, first, out = {}, {}, []
        for i, k in enumerate(self.keys):
            if k not in first:
                first[k] = i
                continue
            if k not in at:
                at[k] = len(at)
                out.append((first[k], at[k]))
            out.append((i, at[k]))
        return np.array(out, np.int64).reshape(-1, 2), len(at)


class Field:
    """weights: of labels by features; chain and skip: potentials of two labels."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def beliefs(self, c: Candidates) -> np.ndarray:
        """Each candidate's distribution over labels, by loopy message passing with damping."""
        n, kinds, base = len(c.spans), len(self.weights), np.array(c.base)
        node = c.features @ self.weights.T
        held = base > 0
        node[held] = -30
        node[held, base[held]] = 0
        skip, n_hubs = c.hubs()
        shown = np.zeros((n_hubs, kinds), bool)
        of = skip[held[skip[:, 0]]]
        shown[of[:, 1], base[of[:, 0]]] = True
        node = np.concatenate([node, np.where(shown.any(axis=1, keepdims=True) & ~shown, -np.inf, 0.0)])
        skip = skip + [0, n]  # hubs come after the candidates
        near = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
        pairs = np.concatenate([near, skip])
        if len(pairs):
            potential = np.concatenate([np.repeat(self.chain[None], n - 1, 0), np.repeat(self.skip[None], len(skip), 0)])
            # Both directions: message k goes from source to target, its reverse is k +- len(pairs).
            source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            both = np.concatenate([potential, potential.transpose(0, 2, 1)])
            turn = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
            message = np.zeros((len(source), kinds))
            for k in count():
                total = node.copy()
                np.add.at(total, target, message)
                out = np.logaddexp.reduce((total[source] - message[turn])[:, :, None] + both, axis=1)
                out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
                step = (out - message) / 2 ** (1 + k // ROUNDS)
                message = message + step
                if np.abs(step).max() < 5e-5:
                    break
            np.add.at(node, target, message)
        node = node[:n]
        return np.exp(node - np.logaddexp.reduce(node, axis=1, keepdims=True))

    def added(self, text: str, base: dict[str, list[Span]]) -> list[tuple[int, int, int]]:
        """Spans beyond the base, as kind, start and end."""
        if not _SIGN.search(text):
            return []
        c = Candidates(text, base)
        if not c.spans or all(c.base):
            return []
        belief = self.beliefs(c)
        label = belief.argmax(axis=1)
        return [(int(label[i]) - 1, *c.spans[i]) for i in range(len(c.spans)) if not c.base[i] and label[i] and belief[i, label[i]] >= SURE]


def _examples(c: Candidates) -> tuple[list, list, list]:
    """Shapes, (left, right, hub) labels (-1: none) and the label of what a text teaches.

    A base span with marks that its kind asks for teaches two things more, both
    apart from others: the same without its marks, which has its label and its
    hub, and another one of that shape, which has neither."""
    shapes, near, label = [], [], []
    hub: dict[str, int] = {}
    for k, y in zip(c.keys, c.base, strict=True):
        hub[k] = max(y, hub.get(k, 0))
    times = Counter(c.keys)
    for i, (k, y) in enumerate(zip(c.keys, c.base, strict=True)):
        if hub[k] and not y:
            continue  # maybe a loose form: nobody says what it is
        shapes.append(c.features[i])
        near.append((c.base[i - 1] if i else -1, c.base[i + 1] if i + 1 < len(c.base) else -1, hub[k] if times[k] > 1 else -1))
        label.append(y)
        bare = c.features[i] * ~MARKS
        if y and (bare != c.features[i]).any():
            shapes += [bare, bare]
            near += [(-1, -1, y), (-1, -1, -1)]
            label += [y, 0]
    return shapes, near, label


def learn(texts: list[str]) -> Field | None:
    """Potentials that maximise the pseudo-likelihood of the texts' labels, each given those beside it."""
    taught = [_examples(Candidates(t, base_spans(t))) for t in texts]
    shapes, near, label = ([x for part in taught for x in part[k]] for k in range(3))
    if not label:
        return None
    kinds = len(KINDS) + 1
    x, near, y = np.array(shapes), np.array(near), np.array(label)
    # Rows of one-hot labels; a label of -1 has none.
    left, right, hub = (np.eye(kinds + 1)[near[:, k], :kinds] for k in range(3))
    one = np.eye(kinds)[y]
    weights, chain, skip = np.zeros((kinds, x.shape[1])), np.zeros((kinds, kinds)), 0.0
    for _ in range(STEPS):
        z = x @ weights.T + left @ chain + right @ chain.T + skip * hub
        g = (np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True)) - one) / len(x)
        weights -= RATE * (g.T @ x + DECAY * weights)
        chain -= RATE * (left.T @ g + g.T @ right + CHAIN_DECAY * chain)
        skip -= RATE * ((g * hub).sum() + DECAY * skip)
    return Field(weights, chain, skip * np.eye(kinds))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """What a bounded sample teaches."""
    # Candidates need a sign or a long number; the sample is drawn among those documents.
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"@|[0-9]{2}[0-9 ().-]{5}")).select("doc_id")
    picked = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").where(F.octet_length("text") <= LONGEST).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return learn([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])


FOUND = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(held):
    def run(batches):
        field = held.value
        for batch in chunks(batches, "text"):
            base, added = [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in spans[k]])
                more = sorted(field.added(text, spans)) if field else []
                added.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in more])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(base, _FOUND), pa.array(added, _FOUND)], names=["doc_id", "base", "added"])

    return run


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, base and added spans of every document."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(_find(held), FOUND)


def _joined(spans):
    """kind:start:end of spans that are in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find(docs, fit(docs))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s.alias("s"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), rank)), lambda x: x["s"])
    return out.select("doc_id", *map(n, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
