"""Evaluation items that stand, whole or in part, in training documents.

Every shard of training text gets a suffix array over its words (by doubling: ranks of 1, 2, 4, 8 and
finally ``min_words`` words). The suffixes of all test items are looked up in every shard by binary search at
the same lengths, those that no longer occur dropping out at each. A hit gives all places in the
shard by its interval of the suffix array; hits that continue each other are one longer match. One
pass over the corpus, no shuffle of text. Items come in blocks of a bounded number of characters (a stated query set): a
shard is indexed once, and the blocks are looked up in it one after the other, so that the driver and a worker hold one block at
a time whatever the item set. Words are compared by 64-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferial.llm.words import words

_BLOCK_CHARS = 2_000_000
ITEM_BLOCK_CHARS = 16_000_000


class SuffixArray:
    """Suffixes of a word sequence sorted by their first ``depth`` words; index of one shard."""

    def __init__(self, names: np.ndarray, depth: int):
        self.depth = depth
        self.keys: list[np.ndarray] = []
        self.alphabet, rank = np.unique(names, return_inverse=True)
        # ranks from 1; 0 stands for the end, and is no item's rank
        rank = rank.astype(np.int64) + 1
        self.steps = []
        have = 1
        while have < depth:
            step = min(have, depth - have)
            self.steps.append(step)
            have += step
        for i, step in enumerate(self.steps):
            shifted = np.zeros_like(rank)
            if step < len(rank):
                shifted[:-step] = rank[step:]
            key = rank * np.int64(len(rank) + 2) + shifted
            if i == len(self.steps) - 1:
                self.order = np.argsort(key, kind="stable")
                self.keys.append(key[self.order])
            else:
                k, rank = np.unique(key, return_inverse=True)
                rank = rank.astype(np.int64) + 1
                self.keys.append(k)
        if not self.steps:
            self.order = np.argsort(rank, kind="stable")
            self.keys.append(rank[self.order])
        self.n = len(names)

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        """1 + place of every x in ``sorted_``, 0 where it is not there."""
        if not len(sorted_):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return np.where(sorted_[at] == x, at + 1, 0)

    def look_up(self, names: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given suffixes of ``names``, those whose first ``depth`` words occur, and their interval of ``order``."""
        rank = self._find(self.alphabet, names)
        lo = hi = np.zeros(0, np.int64)
        if not self.steps:
            suffix = suffix[rank[suffix] > 0]
            return suffix, np.searchsorted(self.keys[0], rank[suffix]), np.searchsorted(self.keys[0], rank[suffix], side="right")
        for i, step in enumerate(self.steps):
            shifted = np.zeros_like(rank)
            if step < len(rank):
                shifted[:-step] = rank[step:]
            key = np.where((rank > 0) & (shifted > 0), rank * np.int64(self.n + 2) + shifted, -1)
            if i == len(self.steps) - 1:
                lo = np.searchsorted(self.keys[i], key[suffix])
                hi = np.searchsorted(self.keys[i], key[suffix], side="right")
            else:
                rank = self._find(self.keys[i], key)
        ok = hi > lo
        return suffix[ok], lo[ok], hi[ok]


def _suffixes(begin: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places where a whole ``depth`` words of the item remain, and the item of each."""
    size = np.maximum(np.diff(begin) - depth + 1, 0)
    item = np.repeat(np.arange(len(size)), size)
    first = np.repeat(begin[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return first + np.arange(int(size.sum())), item


class Shard:
    """A block of texts with the suffix array of its words."""

    def __init__(self, texts: list[str], min_words: int):
        names, self.begin = words(texts)
        self.min_words = min_words
        self.index = SuffixArray(_with_ends(names, self.begin), min_words)

    def matches(self, item_names: np.ndarray, item_begin: np.ndarray) -> dict[str, np.ndarray]:
        """Per text and item: the longest match in words, where it begins in the text and in the item."""
        return _matches(self.index, self.begin, item_names, item_begin, self.min_words)


def _value(block, keep: bool):
    """What a broadcast holds; unless ``keep``, the worker forgets it and reads it from its disk again for the next shard."""
    value = block.value
    if not keep and hasattr(block, "_value"):
        del block._value
    return value


def _matches(sa: SuffixArray, begin: np.ndarray, item_names: np.ndarray, item_begin: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    suffix, item = _suffixes(item_begin, min_words)
    # an item may not run on into the next: the lookup of whole lengths takes care, as suffixes stop in time
    shift = np.arange(len(begin) - 1)  # one end mark after each text
    text_at = begin[:-1] + shift
    by_suffix = np.full(int(suffix.max()) + 1 if len(suffix) else 1, -1, np.int64)
    by_suffix[suffix] = item
    hit, lo, hi = sa.look_up(item_names, suffix)
    size = hi - lo
    place = sa.order[np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))] if len(size) else np.zeros(0, np.int64)
    hit = np.repeat(hit, size)
    text = np.searchsorted(text_at, place, side="right") - 1
    who = by_suffix[hit]
    order = np.lexsort((place, place - hit, who, text))
    text, who, place, hit = text[order], who[order], place[order], hit[order]
    new = np.ones(len(text), bool)
    if len(text) > 1:
        same = (text[1:] == text[:-1]) & (who[1:] == who[:-1]) & (place[1:] - hit[1:] == place[:-1] - hit[:-1]) & (place[1:] == place[:-1] + 1)
        new[1:] = ~same
    run = np.flatnonzero(new)
    length = np.diff(np.append(run, len(text))) + min_words - 1
    text, who, place, hit = text[run], who[run], place[run], hit[run]
    best = np.lexsort((place, -length, who, text))
    text, who, place, hit, length = text[best], who[best], place[best], hit[best], length[best]
    one = np.ones(len(text), bool)
    one[1:] = (text[1:] != text[:-1]) | (who[1:] != who[:-1])
    return {
        "text": text[one], "item": who[one], "words": length[one],
        "doc_word": (place - text_at[text])[one], "item_word": (hit - item_begin[who])[one],
    }


def _with_ends(names: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The words with an end mark after every text, which no word equals (names of words are never 0)."""
    out = np.zeros(len(names) + len(begin) - 1, np.uint64)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out[np.arange(len(names)) + text] = np.maximum(names, 1)
    return out


def find_leaks(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 15) -> DataFrame:
    """``doc_id, item_id, words, doc_word, item_word``: documents that hold ``min_words`` or more consecutive words
    of an item, with the longest match and the 0-based words where it begins.

    Defined results: null and empty texts and items shorter than ``min_words`` match nothing; repeated items
    count once; a document with several texts is judged by each (rows are then not unique); other columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where(F.length("t") > 0).dropDuplicates(["i"])
    total = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // ITEM_BLOCK_CHARS)
    src = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text_col}`").alias("t")).where(F.length("t") > 0)
    dtype, itype = src.schema["d"].dataType.simpleString(), asked.schema["i"].dataType.simpleString()
    shared = []
    for k in range(max(blocks, 1)):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) if blocks > 1 else asked
        rows = part.orderBy("i").toArrow()
        names, begin = words(rows.column("t").to_pylist())
        # the driver keeps a block on disk only
        shared.append(spark.sparkContext.broadcast((np.maximum(names, 1), begin, rows.column("i").combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK_CHARS):
                    size += len(texts[end])
                    end += 1
                shard = Shard(texts[at:end], min_words)
                for block in shared:
                    item_names, item_begin, ids = _value(block, keep=len(shared) == 1)
                    m = shard.matches(item_names, item_begin)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(m["text"] + at)), ids.take(pa.array(m["item"])), *[pa.array(m[c].astype(np.int64)) for c in ("words", "doc_word", "item_word")]],
                        names=["d", "i", "words", "doc_word", "item_word"],
                    )
                at = end

    out = src.mapInArrow(run, f"d {dtype}, i {itype}, words bigint, doc_word bigint, item_word bigint")
    return out.withColumnsRenamed({"d": doc_id, "i": item_id})


def without_leaks(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
