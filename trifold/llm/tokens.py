"""A public byte-level BPE vocabulary, and texts cut where its tokens can't reach across.

``ids`` are those of the tokenizers library at its defaults without the
tokens that it puts around a text: a text is split at the file's added tokens,
which have ids of their own wherever they stand.  ``encode`` takes their
characters like any others.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

#: A single blank between two characters that aren't white space: the pattern
#: of byte-level BPE begins a pre-token there, whatever stands further away, so
#: both sides can be encoded apart.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: Latin-1's visible characters stand
    for themselves, the others in order for 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file.  Its ids are its merge order, so
    another encoder finds the same ids in a quarter of the time."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, step: int) -> list[int]:
    """Places to cut ``text``, each the first safe one at least ``step`` after the last, with both ends."""
    out, at = [0], step
    while at < len(text):
        found = SAFE.search(text, at)
        if not found:
            break
        out.append(found.start())
        at = found.start() + step
    return [*out, len(text)]


def encode(text: str, path: str, step: int = 1 << 18) -> np.ndarray:
    """Token ids; long texts are encoded piece by piece."""
    enc = encoding(path)
    if len(text) <= step:
        return np.array(enc.encode_ordinary(text), np.uint32)
    at = cuts(text, step)
    return np.concatenate([np.array(enc.encode_ordinary(text[a:b]), np.uint32) for a, b in zip(at, at[1:])])  # noqa: B905


@lru_cache(maxsize=4)
def added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The file's added tokens: what finds the leftmost, longest one, and their ids."""
    with open(path, encoding="utf-8") as f:
        own = {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}
    return re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None, own


def ids(text: str, path: str, step: int = 1 << 18) -> np.ndarray:
    """Token ids, those of added tokens among them; no text is cut inside one."""
    find, own = added(path)
    out, at = [], 0
    for m in find.finditer(text) if find else ():
        out += [encode(text[at : m.start()], path, step), np.array([own[m.group()]], np.uint32)]
        at = m.end()
    return np.concatenate([*out, encode(text[at:], path, step)]) if out else encode(text, path, step)


def count(text: str, path: str) -> int:
    """How many ids a text has."""
    find, _ = added(path)
    if find and find.search(text):
        return len(ids(text, path))
    return len(encoding(path).encode_ordinary(text))
