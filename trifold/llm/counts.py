"""Edit-aware token counts.

A document is cut into leaves, runs of whole pre-tokens of about LEAF
characters that end where no token can reach across.  A segment tree over the
leaves sums their characters and tokens.  An edit finds its leaves by their
character sums, widened to the leaves that hold the CONTEXT characters on either
side which decide where pre-tokens begin; only those leaves are encoded again,
and the sums above them are updated.

Trees are kept as a table (doc_id, text, leaf_chars, leaf_tokens), so later
edits start from the counts and not from the texts.

Defined cases: a null or empty text has no leaves and no tokens; edits are
(start, end, text) in code points of the text before any of them, apart from
each other, in any order; null or no edits change nothing; repeated rows are
counted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table
from .tokens import count, cuts, default_path

LEAF, CONTEXT = 512, 2
Edit = tuple[int, int, str]


class Tree:
    """Leaves of a text with their sums of characters and tokens."""

    def __init__(self, text: str, path: str, tokens: list[int] | None = None, chars: list[int] | None = None):
        self.count = lambda piece: count(piece, path)
        if chars is None:
            at = cuts(text, LEAF)
            chars = [b - a for a, b in zip(at, at[1:])]  # noqa: B905
        at, self.leaves = 0, []
        for n in chars:
            self.leaves.append(text[at : at + n])
            at += n
        self.width = 1
        while self.width < max(1, len(self.leaves)):
            self.width *= 2
        pad = [0] * (self.width - len(self.leaves))
        self.chars = [0] * self.width + [len(x) for x in self.leaves] + pad
        self.tokens = [0] * self.width + (list(tokens) if tokens is not None else [self.count(x) for x in self.leaves]) + pad
        for sums in (self.chars, self.tokens):
            for i in range(self.width - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
        self.encoded = 0  # characters encoded again

    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that has character ``at``, and where it begins."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        i = leaf + self.width
        for sums, new in ((self.chars, len(text)), (self.tokens, self.count(text) if text else 0)):
            change, j = new - sums[i], i
            while change and j:
                sums[j] += change
                j //= 2
        self.encoded += len(text)

    def edit(self, start: int, end: int, text: str) -> None:
        size = self.chars[1]
        if not size:
            if text:
                self.leaves = self.leaves or [""]
                self._set(0, text)
            return
        first, begin = self.find(max(0, min(start, size) - CONTEXT))
        last, _ = self.find(min(size - 1, end + CONTEXT - 1))
        old = "".join(self.leaves[first : last + 1])
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "")
        self._set(first, old[: start - begin] + text + old[end - begin :])


TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"
_LONG = pa.list_(pa.int32())


def _trees(path):
    def run(batches):
        for batch in chunks(batches, "text"):
            made = [Tree(t, path) for t in batch.column("text").to_pylist()]
            sums = [pa.array([x[t.width : t.width + len(t.leaves)] for t, x in ((t, getattr(t, k)) for t in made)], _LONG) for k in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), *sums], names=["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return run


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_trees(path or default_path()), TREES)


COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars long, n_chars_encoded long"


def _recount(edits, path):
    def run(batches):
        for batch in chunks(batches, "text"):
            rows = []
            own = batch.column("edits").to_pylist() if edits is None else None
            for k, (doc_id, text, chars, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "leaf_chars", "leaf_tokens")), strict=True)):
                tree = Tree(text, path, tokens, chars)
                todo = [(e["start"], e["end"], e["text"] or "") for e in own[k] or []] if edits is None else edits(text)
                before = tree.total()
                for start, end, new in sorted(todo, reverse=True):  # from the end, so that places stay valid
                    tree.edit(start, end, new)
                rows.append((doc_id, before, len(todo), tree.total(), len(text), tree.encoded))
            names = [x.split()[0] for x in COUNTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

    return run


def recount(kept: DataFrame, edits: Callable[[str], list[Edit]] | None = None, path: str | None = None) -> DataFrame:
    """Counts before and after the edits: those that ``edits`` makes of a text,
    or else those in the column edits, array<struct<start,end,text>>."""
    columns = ["doc_id", "text", "leaf_chars", "leaf_tokens", *(["edits"] if edits is None else [])]
    return kept.select(*columns).mapInArrow(_recount(edits, path or default_path()), COUNTS)


_NUMBER = re.compile(r"[0-9]{4,}")
_LINE = re.compile(r"[^\n]*\n?")


def cleaning(text: str) -> list[Edit]:
    """The edits of a usual cleaning: a line that an earlier one equals goes, and runs of four digits or more become a 0."""
    seen, out = set(), []
    for m in _LINE.finditer(text):
        line = m.group().rstrip("\n")
        if line in seen and line:
            out.append((m.start(), m.end(), ""))
        else:
            seen.add(line)
            out += [(m.start() + n.start(), m.start() + n.end(), "0") for n in _NUMBER.finditer(m.group())]
    return out


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recount(trees(table(spark, sf_dir, "documents")), cleaning)
