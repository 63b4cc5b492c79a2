"""Visually identical text brought to one canonical form.

Every distinct token is read by a weighted edit automaton that walks the trie of the naturally spelled words of the
corpus. Its states are (place in the token, node of the trie, cost). Look-alike letters, other widths, ligatures opened, accents
composed or apart and ignorable characters cost nothing; every other substitution, insertion or deletion costs 1. Within a budget
of 0 the words a token reaches are those a reader cannot tell from it; a greater budget gives its near spellings (``near``). The trie is the
sorted vocabulary itself: a node is an interval of it, an edge narrows the interval by bisection.

Of the words reached the canonical spelling is the cheapest, then one in plain Latin letters, then the most frequent
(ties: the least). Only tokens that reach no word are normalised by table. Both tries and tokens are sharded by the look of a
prefix and the length (a blocking key: words of one look share both), so that no task and no driver holds the vocabulary. Only texts
with non-ASCII characters or tabs are taken apart; ASCII words are their own canonical spelling.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferial.llm.fold import fold_table, look, natural, spellings
from ferial.runtime import checkpoint, text_digest

_SPLIT = r"(?<=[\t\r\n\p{Z}\x85])|(?=[\t\r\n\p{Z}\x85])"
_ODD = r"[^\x20-\x7e\n]"
_HOT_ROWS = 50_000
_SLOTS = 64


class EditWeights:
    """What the automaton may do at a character of a token, and at what cost."""

    def __init__(self):
        self._opened = fold_table()
        self._same = spellings()

    def units(self, ch: str) -> str:
        """The characters that ``ch`` stands for at no cost: none if it is ignorable, several if it joins letters."""
        return self._opened.get(ord(ch), ch)

    def alike(self, unit: str) -> tuple[str, ...]:
        """Letters of words that show the shape of ``unit``: substituted at no cost."""
        return self._same.get(unit, (unit,))


class VocabularyTrie:
    """Natural words, decomposed and sorted; a node is an interval of words that share a prefix."""

    def __init__(self, words: list[tuple[str, int]], weights: EditWeights | None = None):
        decomposed = sorted((unicodedata.normalize("NFD", w), n, w) for w, n in words)
        self.keys = [k for k, _, _ in decomposed]
        self.words = [(w, n) for _, n, w in decomposed]
        self.weights = weights or EditWeights()

    def _child(self, node: tuple[int, int, str], c: str) -> tuple[int, int, str] | None:
        lo, hi, prefix = node
        p = prefix + c
        a = bisect_left(self.keys, p, lo, hi)
        if a == hi or not self.keys[a].startswith(p):
            return None
        return a, bisect_left(self.keys, prefix + chr(ord(c) + 1), a, hi) if ord(c) < 0x10FFFF else hi, p

    def _edges(self, node: tuple[int, int, str]) -> Iterator[str]:
        """The characters that lead on from a node."""
        lo, hi, prefix = node
        at = len(prefix)
        while lo < hi:
            if len(self.keys[lo]) > at:
                c = self.keys[lo][at]
                yield c
                lo = bisect_left(self.keys, prefix + chr(ord(c) + 1), lo, hi) if ord(c) < 0x10FFFF else hi
            else:
                lo += 1

    def near(self, token: str, budget: int = 0) -> list[tuple[int, str, int]]:
        """``(cost, word, count)`` of every word within ``budget`` of the token, cheapest first."""
        # marks of one letter have no order to the eye: read in canonical order, letter by letter
        units = unicodedata.normalize("NFD", "".join(map(self.weights.units, unicodedata.normalize("NFD", token))))
        found: dict[int, int] = {}
        seen: set[tuple[int, str]] = set()
        layers: list[list[tuple[int, tuple[int, int, str]]]] = [[] for _ in range(budget + 1)]
        layers[0].append((0, (0, len(self.keys), "")))
        for cost, states in enumerate(layers):
            while states:
                at, node = states.pop()
                if (at, node[2]) in seen:
                    continue
                seen.add((at, node[2]))
                if at == len(units):
                    i = node[0]
                    while i < node[1] and self.keys[i] == node[2]:
                        found.setdefault(i, cost)
                        i += 1
                else:
                    for c in self.weights.alike(units[at]):
                        if child := self._child(node, c):
                            states.append((at + 1, child))
                if cost == budget:
                    continue
                dearer = layers[cost + 1]
                if at < len(units):
                    dearer.append((at + 1, node))
                for c in self._edges(node):
                    child = self._child(node, c)
                    dearer.append((at, child))
                    if at < len(units):
                        dearer.append((at + 1, child))
        return sorted((k, *self.words[i]) for i, k in found.items())

    def canonical(self, token: str, budget: int = 0) -> str | None:
        """The canonical spelling, None if no word is reached."""
        found = self.near(token, budget)
        if not found:
            return None
        return min(found, key=lambda x: (x[0], look(x[1]) != unicodedata.normalize("NFD", x[1]), -x[2], x[1]))[1]


def by_table(token: str) -> str:
    """The form of a token that is no spelling of a word: every character by its look."""
    return unicodedata.normalize("NFC", look(token))


def spelled(tokens: list[str], trie: VocabularyTrie) -> list[str]:
    """The canonical spelling of every token, by table where the automaton reaches no word."""
    return [by_table(t) if c is None else c for t, c in zip(tokens, map(trie.canonical, tokens))]


def canonical_tokens(tokens: DataFrame) -> DataFrame:
    """``token, canonical`` for every odd token of ``tokens (token, n)``, distinct tokens with counts."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, plain = [], []
            for t in b.column(0).to_pylist():
                seen = look(t)
                shards.append(f"{len(seen)}:{seen[:4]}")
                plain.append(natural(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shards), pa.array(plain)], names=["token", "n", "shard", "natural"])

    def matched(batch: pa.Table) -> pa.Table:
        rows = batch.to_pydict()
        odd = [t for t in rows["token"] if not t.isascii()]
        if not odd:
            return pa.table({"token": pa.array([], pa.string()), "canonical": pa.array([], pa.string())})
        trie = VocabularyTrie([(t, n) for t, n, ok in zip(rows["token"], rows["n"], rows["natural"]) if ok])
        return pa.table({"token": pa.array(odd, pa.string()), "canonical": pa.array(spelled(odd, trie), pa.string())})

    shards = tokens.mapInArrow(keyed, "token string, n bigint, shard string, natural boolean")
    # a shard of ASCII words only has nothing to match; it is dropped before the words are shuffled
    odd = shards.where(F.col("token").rlike(r"[^\x00-\x7f]")).select("shard").distinct()
    return shards.join(odd, "shard", "left_semi").groupBy("shard").applyInArrow(matched, "token string, canonical string")


def _tokens(text: Column) -> Column:
    return F.split(text, _SPLIT, -1)


def canonical_texts(texts: DataFrame) -> DataFrame:
    """``t1, t2, canonical`` for every odd text of ``texts (text)``; t1 and t2 are its digest.

    Odd is a text with a character other than printable ASCII and line feeds; all other texts are canonical.
    """
    t1, t2 = text_digest(F.col("text"))
    some = texts.where(F.length("text") > 0)
    counted = (
        some.select(F.explode(_tokens(F.col("text"))).alias("token")).where(~F.col("token").rlike(r"^[\s]*$")).groupBy("token").agg(F.count("*").alias("n"))
    )
    table = canonical_tokens(counted).where(F.col("token") != F.col("canonical"))
    odd = some.where(F.col("text").rlike(_ODD)).select("text").distinct().withColumns({"t1": t1, "t2": t2})
    parts = odd.select("t1", "t2", F.posexplode(_tokens(F.col("text"))).alias("pos", "token"))
    spelled = parts.join(table, "token", "left").select("t1", "t2", F.struct("pos", F.coalesce("canonical", "token").alias("c")).alias("p"))
    whole = spelled.groupBy("t1", "t2").agg(F.array_join(F.array_sort(F.collect_list("p")).getField("c"), "").alias("canonical"))
    return whole.withColumn("canonical", _blanks(F.col("canonical")))


def _blanks(text: Column) -> Column:
    """Line ends and blanks in one form; a plain replacement of single characters."""
    return F.regexp_replace(F.translate(F.regexp_replace(text, "\r\n", "\n"), "\u2028\u2029\x85\t", "\n\n\n "), r"\p{Zs}", " ")


def normalise(df: DataFrame, text_col: str, out_col: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text_col``. Null stays null, the empty text empty."""
    src = df.withColumns(dict(zip(("__t1", "__t2"), text_digest(F.col(f"`{text_col}`")))))
    forms = canonical_texts(df.select(F.col(f"`{text_col}`").alias("text"))).select(
        F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("canonical").alias("__c")
    )
    out = src.join(forms, ["__t1", "__t2"], "left").withColumn(out_col, F.coalesce("__c", F.col(f"`{text_col}`")))
    return out.drop("__t1", "__t2", "__c")


def _classes(base: DataFrame) -> DataFrame:
    """``t1, t2, n, c1, c2``: the texts of ``base (id, text)`` that share their canonical form with a different text.

    t is a text's digest, n the number of its rows, c the digest of the canonical form.
    """
    t1, t2 = text_digest(F.col("text"))
    forms = checkpoint(canonical_texts(base.select("text")).select("t1", "t2", *[c.alias(n) for c, n in zip(text_digest(F.col("canonical")), ("c1", "c2"))]))
    # classes can differ only where an odd text is: all others are their own canonical form
    texts = base.select("id", t1.alias("t1"), t2.alias("t2")).groupBy("t1", "t2").agg(F.count("*").alias("n"))
    keyed = texts.join(forms, ["t1", "t2"], "left").select(
        "t1", "t2", "n", F.coalesce("c1", "t1").alias("c1"), F.coalesce("c2", "t2").alias("c2")
    )
    mixed = keyed.join(forms.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi")
    several = mixed.groupBy("c1", "c2").agg(F.count("*").alias("k")).where("k > 1").select("c1", "c2")
    return checkpoint(mixed.join(several, ["c1", "c2"], "left_semi"))


def _base(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)


def lookalike_classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, class_id, links``: every row whose text looks like a differently stored one, the least id of its class, and
    how many rows of the class are stored differently. Its size is that of the rows, however large a class.

    Defined results as in ``lookalike_pairs``; an id with several texts has a row for each.
    """
    base = _base(rows, id_col, text_col)
    t1, t2 = text_digest(F.col("text"))
    held = base.select("id", t1.alias("t1"), t2.alias("t2")).distinct().join(_classes(base).drop("n"), ["t1", "t2"])
    # texts first, then classes: a hot class is summed up before it meets its rows
    per_text = held.groupBy("c1", "c2", "t1", "t2").agg(F.count("*").alias("own"), F.min("id").alias("least"))
    per_class = per_text.groupBy("c1", "c2").agg(F.sum("own").alias("all"), F.min("least").alias("class_id"))
    sizes = per_text.join(per_class, ["c1", "c2"]).select("t1", "t2", "class_id", (F.col("all") - F.col("own")).alias("links"))
    return held.select("id", "t1", "t2").join(sizes, ["t1", "t2"]).select(F.col("id").alias(id_col), "class_id", "links")


def lookalike_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row_a, row_b``: every pair of ids whose non-empty texts look the same and are stored differently.

    Defined results: null and empty texts take no part; a row repeated under the same id counts once;
    other columns are ignored. Within a class only pairs of different texts are formed (distinct texts
    first, then their rows); a text with more than 50,000 rows is spread over 64 slots.
    """
    base = _base(rows, id_col, text_col)
    t1, t2 = text_digest(F.col("text"))
    ids = base.select("id", t1.alias("t1"), t2.alias("t2"))
    classes = _classes(base)

    spread = F.when(F.col("n") > _HOT_ROWS, F.pmod(F.xxhash64("id"), F.lit(_SLOTS)).cast("int")).otherwise(0)
    held = checkpoint(ids.distinct().join(classes, ["t1", "t2"]).select("id", "t1", "t2", spread.alias("slot")))
    a = classes.select("c1", "c2", F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("n").alias("na"))
    b = classes.select("c1", "c2", F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("n").alias("nb"))
    before = F.struct("a1", "a2") < F.struct("b1", "b2")
    slots = lambda n: F.when(F.col(n) > _HOT_ROWS, F.sequence(F.lit(0), F.lit(_SLOTS - 1))).otherwise(F.array(F.lit(0)))
    pairs = a.join(b, ["c1", "c2"]).where(before).select("a1", "a2", "b1", "b2", F.explode(slots("na")).alias("sa"), "nb")
    pairs = pairs.select("a1", "a2", "sa", "b1", "b2", F.explode(slots("nb")).alias("sb"))
    left = held.select(F.col("id").alias("ia"), F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("slot").alias("sa"))
    right = held.select(F.col("id").alias("ib"), F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("slot").alias("sb"))
    found = pairs.join(left, ["a1", "a2", "sa"]).join(right, ["b1", "b2", "sb"])
    return found.where(F.col("ia") != F.col("ib")).select(F.least("ia", "ib").alias("row_a"), F.greatest("ia", "ib").alias("row_b")).distinct()
