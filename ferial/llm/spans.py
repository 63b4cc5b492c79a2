"""Long exact spans that records share, found by recompression.

A text is parsed into symbols in rounds. Each round is a Spark job over all texts: it counts the pairs of neighbouring
symbols globally, splits the alphabet of the most frequent ones into left and right symbols so that much is joined (a greedy
maximum cut), and names every pair of a left and a right symbol. A pair is one symbol from then on, in every
text, so equal substrings get equal symbols but for their ends. The first round also names runs of two equal characters.
Symbols of round r have at most 2^r characters, and whether two join depends on the two alone, so a boundary of round r is decided
within ``_context(r)`` characters.

A high-level symbol begins at a boundary of the last round and spells at least ``spell`` characters, up to a boundary of the
round before. Any two equal substrings of ``min_chars`` hold a common one (``_layout``). High-level symbols of
two different texts reveal candidates; all windows of ``min_chars`` around them are then named by 128-bit hashes, and those
of more than one text are the shared ones. Groups are aggregated (never paired), texts that are equal count as one before
any of this, and their ids come back at the end.

The naming tables hold at most ``NAMES`` pairs a round, whatever the corpus: more would make the symbols longer and so
the work less, but no result depends on it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferial.runtime import broadcast_below, text_digest, written

NAMES = 1 << 16
_ROUNDS = 6
_BLOCK_CHARS = 1_000_000
_LEN_BITS = 20  # a place is a position and a length in one long
_MARKS = 4_000_000  # places that may be broadcast
_LIVE = 1_000_000  # names that may be broadcast
_HELD_PAIRS = 1 << 20  # counts a task holds before it passes them on
_RUN_NAME, _PAIR_NAME = 0x110000, 0x220000  # names below are characters, then runs of two, then pairs
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@cache
def _block_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, for blocks of up to ``size`` characters."""
    return _powers(np.uint64(base), size), _powers(np.uint64(pow(base, -1, 2**64)), size)


class Hashes:
    """Hashes of any substrings of one block of characters, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, chars: np.ndarray, base: np.uint64, salt: int):
        with np.errstate(over="ignore"):
            # a power of two not below the block, so that few sizes are kept
            power, self.back = _block_powers(int(base), 1 << max(len(chars), 1).bit_length())
            self.sums = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum(_mix(chars.astype(np.uint64), salt) * power[: len(chars)], out=self.sums[1:])
        self.salt = salt

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[stop] - self.sums[start]) * self.back[start], self.salt + 7)


class Names:
    """What one round names: pairs in order and the symbols that stand for them."""

    def __init__(self, pairs: np.ndarray, names: np.ndarray):
        self.pairs, self.names = pairs, names

    @cached_property
    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Per symbol: is it the left, is it the right of any pair? Most neighbours are told apart by these."""
        a, b = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        sides = np.zeros((2, _PAIR_NAME + _ROUNDS * NAMES), bool)
        sides[0, a], sides[1, b] = True, True
        return sides[0], sides[1]

    @cached_property
    def _slots(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """A hash table of the pairs: slots hold a pair and its place; pairs that find theirs taken stay in order beside it."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        slot = self._slot(self.pairs, bits)
        _, first = np.unique(slot, return_index=True)
        keys, at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys[slot[first]], at[slot[first]] = self.pairs[first], first
        rest = np.ones(len(self.pairs), bool)
        rest[first] = False
        return bits, keys, at, np.flatnonzero(rest)

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _B1) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of every pair among the named ones, -1 if it is none."""
        bits, keys, at, rest = self._slots
        slot = self._slot(key, bits)
        held = keys[slot]
        hit = held == key
        out = np.where(hit, at[slot], -1)
        if len(rest):
            miss = np.flatnonzero(~hit & (held >= 0))
            near = np.minimum(np.searchsorted(self.pairs[rest], key[miss]), len(rest) - 1)
            good = self.pairs[rest][near] == key[miss]
            out[miss[good]] = rest[near[good]]
        return out

    def __reduce__(self):
        return Names, (self.pairs, self.names)


def _context(r: int) -> int:
    """Characters to either side that decide a boundary of round r: two for runs, then the longest symbol of every round before."""
    return 2**r + 2 if r else 0


def _layout(min_chars: int) -> tuple[int, int]:
    """The number of rounds, and how many characters a high-level symbol spells at least.

    Within equal substrings boundaries agree ``_context`` from the ends; up to a symbol less one is lost before the first of
    the last round, and as much of the round before after the last character spelled.
    """
    if not 1 <= min_chars < 1 << _LEN_BITS:
        raise ValueError(f"min_chars must be from 1 to {(1 << _LEN_BITS) - 1}")
    for r in range(_ROUNDS, 0, -1):
        spell = min_chars - _context(r) - (2**r - 1) - (2 ** (r - 1) - 1) - _context(r - 1)
        if 3 * spell >= min_chars:
            return r, spell
    return 0, min_chars


def _pairs(start: np.ndarray, symbol: np.ndarray, doc_start: np.ndarray, r: int, among: Names | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours that round r may join (``among``: names may have been given to): where the right one stands among the
    symbols, and the pair as one number."""
    if among is None:
        right = np.arange(1, len(start))
    else:
        left_side, right_side = among.sides
        right = 1 + np.flatnonzero(left_side[symbol[:-1]] & right_side[symbol[1:]])
    after = np.append(start, len(doc_start))[right + 1]
    right = right[(after - start[right - 1] <= 2**r) & ~doc_start[start[right]]]
    return right, symbol[right - 1] << 32 | symbol[right]


def parse(chars: np.ndarray, doc_start: np.ndarray, tables: list[Names]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and names of the symbols before and after each of the rounds, over texts laid end to end (``doc_start``: True at a first character)."""
    n = len(chars)
    start, symbol = np.arange(n), chars.astype(np.int64)
    levels = [(start, symbol)]
    for r, named in enumerate(tables, 1):
        if r == 1:
            start, symbol = _named_runs(chars, doc_start)
        if len(named.pairs):
            right, key = _pairs(start, symbol, doc_start, r, named)
            at = named.find(key)
            hit = at >= 0
            right, at = right[hit], at[hit]
            symbol = symbol.copy()
            symbol[right - 1] = named.names[at]
            keep = np.ones(len(start), bool)
            keep[right] = False
            start, symbol = start[keep], symbol[keep]
        levels.append((start, symbol))
    return levels


def _named_runs(chars: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of exactly two equal characters as one symbol; characters of longer runs stay single."""
    n = len(chars)
    same = np.zeros(n, bool)
    same[1:] = (chars[1:] == chars[:-1]) & ~doc_start[1:]
    follows = np.zeros(n, bool)
    follows[:-1] = same[1:]
    precedes = np.zeros(n, bool)
    precedes[1:] = same[:-1]
    start = np.flatnonzero(~(same & ~follows & ~precedes))
    size = np.diff(np.append(start, n))
    return start, chars[start].astype(np.int64) + np.where(size == 2, _RUN_NAME, 0)


def maximum_cut(pairs: list[tuple[int, int, int]]) -> set[int]:
    """The left symbols of a split of the alphabet: symbols by weight, each to the side where it is expected to join more."""
    after, before, weight = defaultdict(list), defaultdict(list), defaultdict(int)
    for a, b, n in pairs:
        if a != b:
            after[a].append((b, n))
            before[b].append((a, n))
            weight[a] += n
            weight[b] += n
    left: dict[int, bool] = {}
    for s in sorted(weight, key=lambda x: (-weight[x], x)):
        as_left = sum(n * (0.5 if b not in left else not left[b]) for b, n in after[s])
        as_right = sum(n * (0.5 if a not in left else left[a]) for a, n in before[s])
        left[s] = as_left >= as_right
    return {s for s, is_left in left.items() if is_left}


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Per block of the batches of ``(t, text)``: characters, offsets, first characters, and t."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in _blocks(texts):
            chars, offsets = _chars(texts[i:j])
            doc_start = np.zeros(len(chars) + 1, bool)
            doc_start[offsets] = True
            yield chars, offsets, doc_start[:-1], b.column(0).slice(i, j - i)


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in counts]))
    return key, n


def _pair_batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["pair", "n"])


def name_pairs(texts: DataFrame, tables: list[Names]) -> Names:
    """The next round: counts all pairs of all texts as the rounds so far parse them, and names those that are joined."""
    r = len(tables) + 1
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for chars, _, doc_start, _ in _texts_of(batches):
            levels = parse(chars, doc_start, shared.value)
            start, symbol = levels[-1] if r > 1 else _named_runs(chars, doc_start)
            held.append(np.unique(_pairs(start, symbol, doc_start, r)[1], return_counts=True))
            if sum(len(k) for k, _ in held) > _HELD_PAIRS:
                held = [_summed(held)]
                if len(held[0][0]) > _HELD_PAIRS // 2:
                    yield _pair_batch(*held.pop())
        if held:
            yield _pair_batch(*_summed(held))

    counts = texts.select("t", "text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    top = [(p >> 32, p & 0xFFFFFFFF, n) for p, n in counts.orderBy(F.desc("n"), "pair").limit(NAMES).collect()]
    left = maximum_cut(top)
    joined = np.sort(np.array([a << 32 | b for a, b, _ in top if a != b and a in left and b not in left], np.int64))
    return Names(joined, np.arange(len(joined), dtype=np.int64) + (_PAIR_NAME + (r - 1) * NAMES))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _BLOCK_CHARS:
            yield at, i
            at = i
            size = 0
        size += len(t)
    if texts:
        yield at, len(texts)


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(data, np.uint32), offsets


def high_symbols(chars: np.ndarray, offsets: np.ndarray, doc_start: np.ndarray, tables: list[Names], spell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends of the high-level symbols."""
    levels = parse(chars, doc_start, tables)
    n = len(chars)
    start, edge = levels[-1][0], levels[-2][0] if tables else levels[-1][0]
    # where every text ends, and how many edges stand before each place: two passes instead of a search for each symbol
    end = np.repeat(offsets[1:], np.diff(offsets))[start] if n else start
    ok = start + spell <= end
    start, end = start[ok], end[ok]
    before = np.zeros(n + 1, np.int32)
    before[edge + 1] = 1
    np.cumsum(before, out=before)
    stop = np.append(edge, n)[before[start + spell]]
    ok = stop <= end
    start, stop = start[ok], stop[ok]
    return Hashes(chars, _B1, 0).of(start, stop), start, stop


def _name_batches(tables, spell: int):
    """``name, t`` of the high-level symbols of every block: a name with its least text, and its greatest if that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chars, offsets, doc_start, t in _texts_of(batches):
            name, start, _ = high_symbols(chars, offsets, doc_start, tables.value, spell)
            t = np.repeat(np.asarray(t), np.diff(offsets))[start]
            order = np.lexsort((t, name))
            name, t = name[order], t[order]
            first = np.ones(len(name), bool)
            first[1:] = name[1:] != name[:-1]
            last = np.append(first[1:], True) if len(name) else first
            opening = np.flatnonzero(first)
            other = t[last] != t[opening]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((name[opening], name[opening][other])).view(np.int64)), pa.array(np.concatenate((t[opening], t[last][other])))], names=["name", "t"]
            )

    return run


def _place_batches(tables, spell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chars, offsets, doc_start, t in _texts_of(batches):
            name, start, stop = high_symbols(chars, offsets, doc_start, tables.value, spell)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[start]
            place = (start - offsets[doc]) << _LEN_BITS | (stop - start)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), t.take(pa.array(doc)), pa.array(place)], names=["name", "t", "place"])

    return run


def _window_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            marks = b.column(2)
            for i, j in _blocks(texts):
                chars, offsets = _chars(texts[i:j])
                part = marks.slice(i, j - i)
                flat = part.flatten()
                doc = np.repeat(np.arange(j - i), np.asarray(part.value_lengths()))
                flat = np.asarray(flat)
                pos = offsets[doc] + (flat >> _LEN_BITS)
                end = pos + (flat & ((1 << _LEN_BITS) - 1))
                lo = np.maximum(end - min_chars, offsets[doc])
                hi = np.minimum(pos, offsets[doc + 1] - min_chars) + 1
                ok = hi > lo
                change = np.zeros(len(chars) + 1, np.int64)
                np.add.at(change, lo[ok], 1)
                np.add.at(change, hi[ok], -1)
                start = np.flatnonzero(np.cumsum(change)[:-1] > 0)
                doc = np.searchsorted(offsets, start, side="right") - 1
                stop = start + min_chars
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(Hashes(chars, _B1, 1).of(start, stop).view(np.int64)), pa.array(Hashes(chars, _B2, 2).of(start, stop).view(np.int64)),
                        b.column(0).take(rows), pa.array((start - offsets[doc]).astype(np.int32)),
                    ],
                    names=["w1", "w2", "t", "pos"],
                )

    return run


def _in_two_texts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in more than one text; partial aggregates before the shuffle, whatever a key's size."""
    return df.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(*keys)


def revealed(texts: DataFrame, tables: list[Names], spell: int) -> DataFrame:
    """``t, marks``: the texts that share a high-level symbol with another, and where such symbols stand in them."""
    src, shared = texts.select("t", "text"), texts.sparkSession.sparkContext.broadcast(tables)
    # blocks give a name at most twice, so a plain exchange moves less than partial aggregates of mostly single names
    names = src.mapInArrow(_name_batches(shared, spell), "name bigint, t bigint").repartition("name")
    live = written(_in_two_texts(names, ["name"]))
    places = src.mapInArrow(_place_batches(shared, spell), "name bigint, t bigint, place bigint")
    return places.join(broadcast_below(live, F.lit(1), _LIVE), "name", "left_semi").groupBy("t").agg(F.collect_list("place").alias("marks"))


def shared_chars(rows: DataFrame, id_col: str, text_col: str, min_chars: int = 80) -> DataFrame:
    """``id, shared_chars``: per id how many characters lie in runs of ``min_chars`` or more that stand identically
    under another id; only ids with some.

    Defined results: null, empty and short texts share nothing; a row repeated under its own id counts once; equal
    texts under different ids are shared whole; other columns are ignored. An id with several texts is judged
    by its greatest text. ``min_chars`` is at least 1.
    """
    rounds, spell = _layout(min_chars)
    t1, t2 = text_digest(F.col("text"))
    base = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") >= min_chars)
    base = base.select("id", "text", t1.alias("t1"), t2.alias("t2"))
    several = (F.min("id") != F.max("id")).alias("several")
    # numbered before they are written, so that every later job reads the same numbers
    texts = written(base.groupBy("t1", "t2").agg(F.first("text").alias("text"), several).withColumn("t", F.monotonically_increasing_id()))

    tables: list[Names] = []
    for _ in range(rounds):
        tables.append(name_pairs(texts, tables))
    marks = written(revealed(texts, tables, spell))
    # texts held by several ids are shared whole; their windows are still needed by others
    candidates = texts.select("t", "text").join(broadcast_below(marks, F.size("marks"), _MARKS), "t").select("t", "text", "marks")
    windows = written(candidates.mapInArrow(_window_batches(min_chars), "w1 bigint, w2 bigint, t bigint, pos int"))
    held = windows.join(_in_two_texts(windows, ["w1", "w2"]), ["w1", "w2"], "left_semi").select("t", "pos")
    size = F.lit(min_chars)
    # the window and the sum need one exchange by text; its rows spill, no list is held
    gap = F.lead("pos").over(Window.partitionBy("t").orderBy("pos")) - F.col("pos")
    covered = held.withColumn("gap", F.least(size, F.coalesce(gap, size))).groupBy("t").agg(F.sum("gap").cast("bigint").alias("part"))
    whole = F.when(F.col("several"), F.length("text").cast("bigint"))
    found = texts.select("t", "t1", "t2", whole.alias("whole")).join(covered, "t", "left").select("t1", "t2", F.coalesce("whole", "part").alias("shared_chars")).where("shared_chars > 0")
    ids = base.groupBy("id").agg(F.max(F.struct("t1", "t2")).alias("t")).select("id", "t.t1", "t.t2")
    return ids.join(found, ["t1", "t2"]).select(F.col("id").alias(id_col), "shared_chars")
