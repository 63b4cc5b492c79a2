"""Lookups: ranked containment, verse ranges, fallbacks and paragraph intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.functions.text import grams

#: keys that are broadcast and compared one by one; beyond that candidates come from an equi join on three letters
MAX_KEYS = 10_000


def _holding(hay: DataFrame, text: str, needles: DataFrame, part: str, hold: Column) -> DataFrame:
    """Pairs of a ``hay`` row and a ``needles`` row that meet ``hold``, a test that implies that ``part`` stands in ``text`` without
    regard to case. Neither side may have the other's columns."""
    if not _many(needles):
        return hay.join(F.broadcast(needles), hold)
    low, small_ = F.lower(text), F.lower(part)
    size = F.least(F.length(small_), F.lit(3))
    keyed = needles.withColumn("__g", F.substring(small_, 1, 3)).withColumn("__z", size)
    # only the sizes that occur: three, and less for parts as short
    sizes = sorted(r[0] for r in keyed.select("__z").distinct().collect() if r[0] is not None)

    parts = F.flatten(F.array(*[grams(low, z) for z in sizes]))
    found = hay.withColumn("__g", F.explode(F.array_distinct(parts))) if sizes else hay.withColumn("__g", F.lit(None).cast("string"))
    return found.join(keyed.drop("__z"), "__g").where(hold).drop("__g")


def _many(keys: DataFrame) -> bool:
    return keys.limit(MAX_KEYS + 1).count() > MAX_KEYS


def whole_name_at(name: Column, key: Column) -> Column:
    """1-based place where ``key`` stands in ``name`` as a whole name, without regard to case; 0 if nowhere."""
    quoted = F.concat(F.lit(r"(?<!\p{L})\Q"), F.lower(key), F.lit(r"\E(?!\p{L})"))
    return F.regexp_instr(F.lower(name), quoted)


def ranked_contains(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """Per distinct name the key it is known by, as ``name, key, tier``.

    Tier 1: equal without regard to case; 2: the key is a whole name in it (earliest, longest, least); 3: it is
    part of the key (shortest, least); no row where none holds. Null and empty names and keys take no part.
    """
    k = keys.select(F.col(key).alias("__k")).where("__k <> ''").distinct()
    n = names.select(F.col(name).alias("__n")).where("__n <> ''").distinct()
    at = whole_name_at(F.col("__n"), F.col("__k"))
    tier = F.when(F.lower("__n") == F.lower("__k"), 1).when(F.col("at") > 0, 2).when(F.contains(F.lower("__k"), F.lower("__n")), 3)
    inside = _holding(n, "__n", k, "__k", at > 0)
    around = _holding(k, "__k", n, "__n", F.contains(F.lower("__k"), F.lower("__n"))) if _many(k) else n.join(F.broadcast(k), F.contains(F.lower("__k"), F.lower("__n")))
    hits = inside.unionByName(around).withColumn("at", at).withColumn("tier", tier)
    size = F.length("__k")
    order = F.struct(F.col("tier"), F.when(F.col("tier") == 2, F.col("at")).otherwise(0), F.when(F.col("tier") == 2, -size).otherwise(size), F.col("__k"))
    best = hits.groupBy("__n").agg(F.min(order).alias("b"))
    return best.select(F.col("__n").alias(name), F.col("b.__k").alias(key), F.col("b.tier").alias("tier"))


def distinct_people(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """The keys that occupy different parts of a name: overlapping hits count as the earliest, longest one."""
    k = keys.select(F.col(key).alias("__k")).where("__k <> ''").distinct()
    n = names.select(F.col(name).alias("__n")).where("__n <> ''").distinct()
    at = whole_name_at(F.col("__n"), F.col("__k"))
    hits = _holding(n, "__n", k, "__k", at > 0).withColumn("at", at).withColumn("end", at + F.length("__k"))
    return overlap_islands(hits, ["__n"], "at", "end", ["__k"]).select(F.col("__n").alias(name), F.col("__k").alias(key), "at")


def overlap_islands(df: DataFrame, part: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Intervals that begin where no earlier one still runs; of those that begin together the longest."""
    w = Window.partitionBy(*part).orderBy(start, F.col(end).desc(), *ties)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col(start) >= F.col("__reach"))).drop("__reach")


def longest_phrase(df: DataFrame, text: str, phrases: DataFrame, phrase: str, tag: str) -> DataFrame:
    """Each row with the tag of the longest phrase its text holds, null without one (ties: the least phrase)."""
    k = phrases.select(F.lower(phrase).alias("__p"), F.col(tag).alias("__t")).where("__p <> ''")
    texts = df.select(F.col(text).alias("__x")).where("__x IS NOT NULL").distinct()
    hits = _holding(texts, "__x", k, "__p", F.contains(F.lower("__x"), F.col("__p"))).groupBy("__x").agg(F.min(F.struct(-F.length("__p"), "__p", "__t")).alias("b"))
    best = hits.select("__x", F.col("b.__t").alias(tag))
    return df.join(best, df[text] == best["__x"], "left").drop("__x")


def containment_either_way(left: DataFrame, right: DataFrame, on: str, a: str, b: str, pos: str) -> DataFrame:
    """Per left row the first right row (by ``pos``) of the same ``on`` whose text holds its own or is held by it."""
    r = right.select(on, F.col(b).alias("__b"), F.col(pos).alias("__pos"))
    norm = lambda c: F.regexp_replace(F.lower(F.translate(c, "’", "'")), r"^(?:the )", "")
    x, y = norm(F.col(a)), norm(F.col("__b"))
    hits = left.join(r, on).where(F.contains(x, y) | F.contains(y, x))
    return hits.groupBy(*left.columns).agg(F.min(F.struct("__pos", "__b")).alias("m")).select(*left.columns, F.col("m.__b").alias(b), F.col("m.__pos").alias(pos))


def verses_in_ranges(ranges: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses of ``(book, ch, v, …)`` in ranges ``(book, start_ch, start_v, end_ch, end_v, …)``.

    Ranges meet the few chapters of their book first, so that verses join by (book, chapter); the place is a residual
    comparison of (chapter, verse) pairs, so first, middle and last chapters need no cases; reversed ranges hold nothing.
    """
    place = F.struct(F.col("ch"), F.col("v"))
    low = F.struct(F.col("start_ch").alias("ch"), F.col("start_v").alias("v"))
    high = F.struct(F.col("end_ch").alias("ch"), F.col("end_v").alias("v"))
    chapters = verses.select("book", "ch").distinct()
    near = ranges.join(chapters, "book").where(F.col("ch").between(F.col("start_ch"), F.col("end_ch")))
    return near.join(verses, ["book", "ch"]).where((place >= low) & (place <= high))


def fallback(wanted: DataFrame, first: DataFrame, second: DataFrame, on: str, value: str) -> DataFrame:
    """``value`` from ``first``, else ``second``, and which it was (``source``: first, second or none)."""
    a = first.select(on, F.col(value).alias("__a")).dropDuplicates([on])
    b = second.select(on, F.col(value).alias("__b")).dropDuplicates([on])
    out = wanted.join(a, on, "left").join(b, on, "left").withColumn(value, F.coalesce("__a", "__b"))
    source = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").otherwise("none")
    return out.withColumn("source", source).drop("__a", "__b")


def paragraphs(verses: DataFrame, breaks: DataFrame) -> DataFrame:
    """Verses with the first verse of their paragraph; before a chapter's first break they are dropped, in a chapter without breaks all are one."""
    w = Window.partitionBy("book", "ch").orderBy("first_v")
    iv = breaks.select("book", "ch", "first_v").distinct().withColumn("__next", F.lead("first_v").over(w))
    has = iv.select("book", "ch").distinct().withColumn("__has", F.lit(True))
    v = verses.join(has, ["book", "ch"], "left")
    inside = (F.col("v") >= F.col("first_v")) & (F.col("__next").isNull() | (F.col("v") < F.col("__next")))
    some = v.where("__has").join(iv, ["book", "ch"]).where(inside).drop("__has", "__next")
    return some.unionByName(v.where("__has IS NULL").drop("__has").withColumn("first_v", F.lit(None).cast("int")))
