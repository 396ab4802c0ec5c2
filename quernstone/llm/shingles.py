"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import re

import numpy as np

GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
#: Spaces, punctuation and signs beyond ASCII, and scripts that put no spaces between words.
_BREAKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b9\u00bb-\u00bf\u1680\u2000-\u206f\u2190-\u2bff\u3000-\u303f\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that changes all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, GROUP_BYTES) + 1, base, np.uint64))])
    return _powers


def spaced(text: str) -> str:
    """The text in lower case with spaces for breaks beyond ASCII and around each letter of a script without spaces."""
    text = text.lower()
    return text if text.isascii() else _UNSPACED.sub(r" \g<0> ", _BREAKS.sub(" ", text))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word, in order.

    A word is a run of ASCII letters and digits and of characters beyond ASCII that are
    no spaces or punctuation, in lower case; in scripts that put no spaces between
    words each letter is one.  Hashes are differences of running sums of bytes times powers.
    """
    hashes, owners, group, first, size = [], [], [], 0, 0
    raws = [spaced(t).encode() for t in texts]

    def flush() -> None:
        data = np.frombuffer(b"\0" + b"\0".join(group) + b"\0", np.uint8)
        up, down = _power_tables(len(data) + 1)
        inside = _WORD[data]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = change[::2], change[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)])
        hashes.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        offsets = np.cumsum([1] + [len(r) + 1 for r in group[:-1]])
        owners.append(np.searchsorted(offsets, start, side="right") - 1 + first)

    for k, raw in enumerate(raws):
        if group and size + len(raw) > GROUP_BYTES:
            flush()
            group, first, size = [], k, 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        flush()
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (none, none.astype(np.int64))


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, its text's number, words of each text, hash of each text's words).

    Each text has one shingle a window of ``width`` words; a shorter one has one
    shingle of all its words, and one without words has none.
    """
    words, owner = word_hashes(texts)
    n = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])[:-1] if len(texts) else n
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        factor = np.uint64(pow(_BASE, 2 * k + 3, 1 << 64))
        tail = words[k:] * factor
        same = owner[k:] == owner[: len(tail)]
        total[: len(tail)] += np.where(same, tail, np.uint64(0))
    place = np.arange(len(words)) - first[owner] if len(words) else owner
    keep = (place + width <= n[owner]) | ((place == 0) & (n[owner] < width)) if len(words) else np.zeros(0, bool)
    return mix(total[keep]), owner[keep], n, first
