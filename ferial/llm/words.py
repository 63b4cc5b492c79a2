"""Words of whole batches of texts as 64-bit names, blind to case, punctuation, blanks and look-alikes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from ferial.llm.fold import LOOKALIKES, fold_table
from ferial.llm.spans import _mix, _powers

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR, _LETTER, _MARK = 0, 1, 2


@cache
def _same_letter() -> dict[str, str]:
    """One name for all letters that case or look connect, directly or by others."""
    up: dict[str, str] = {}

    def find(a: str) -> str:
        while up.get(a, a) != a:
            a = up[a]
        return a

    def union(a: str, b: str) -> None:
        a, b = sorted((find(a), find(b)))
        up[b] = a

    for letters, shapes in LOOKALIKES:
        for a, b in zip(letters, shapes):
            for x, y in ((a, b), (a, a.casefold()), (b, b.casefold()), (a, a.upper())):
                if len(x) == len(y) == 1:
                    union(x, y)
    return {a: find(a) for a in list(up)}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: how many units it gives, where they begin, and the units' kinds and values."""
    fold, same = fold_table(), _same_letter()
    size, first = np.ones(0x110000, np.uint8), np.zeros(0x110000, np.int64)
    kinds, values, at = [], [], {}

    def unit(u: str) -> tuple[int, int]:
        cat = unicodedata.category(u)
        kind = _MARK if cat[0] == "M" else _LETTER if cat[0] == "L" or cat[0] == "N" else _SEPARATOR
        return kind, ord(same.get(u, u))

    def put(seq: tuple) -> int:
        if seq not in at:
            at[seq] = len(kinds)
            kinds.extend(k for k, _ in seq)
            values.extend(v for _, v in seq)
        return at[seq]

    separator = put(((_SEPARATOR, 0),))
    first[:] = separator
    for cp in range(0x30000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cp not in fold and cat[0] not in "LMN":
            continue
        seen = unicodedata.normalize("NFD", ch).translate(fold).casefold()
        seen = unicodedata.normalize("NFD", seen).translate(fold)
        seq = tuple(unit(u) for u in seen)
        size[cp] = len(seq)
        first[cp] = put(seq) if seq else 0
    return size, first, np.array(kinds, np.uint8), np.array(values, np.uint64), np.array([separator])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of all texts in order, and for each text where its words begin (one more at the end).

    A word is a run of letters and digits with their accents; accents count, their order and composition don't.
    """
    joined = "\n".join(texts) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    size, first, kinds, values, _ = _tables()
    n = size[chars]
    at = first[chars]
    total = np.cumsum(n, dtype=np.int64)
    text_end = total[ends - 1] if len(texts) else np.zeros(0, np.int64)
    if (n != 1).any():
        begin = total - n
        at = np.repeat(at - begin, n) + np.arange(total[-1])
    kind, value = kinds[at], values[at]
    inside = kind != _SEPARATOR
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    place = np.cumsum(kind == _LETTER)
    with np.errstate(over="ignore"):
        step = int(place[-1]) + 1 if len(place) else 1
        power = _powers(_BASE, step)
        inverse = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), step)
        term = _mix(value + kind.astype(np.uint64) * np.uint64(1 << 32), 3) * power[place]
        term[~inside] = 0
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        names = _mix((sums[stop] - sums[start]) * inverse[place[start]], 5)
    return names, np.concatenate(([0], np.searchsorted(start, text_end)))
