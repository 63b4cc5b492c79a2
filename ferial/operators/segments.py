"""Flattened recursive forms: dereference, runs, forward fill and repositioning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.operators.hot import last_known
from ferial.runtime import checkpoint, written


def reach(edges: DataFrame) -> DataFrame:
    """``key, target, depth``: every target that a key reaches through ``edges (key, target)``, by its shortest way.

    Paths double in every round, so a chain of n links takes about log2(n) of them; cycles end because only the shortest
    way between two keys is kept. It stops when a round reaches nothing new.
    """
    links = edges.where("key IS NOT NULL AND target IS NOT NULL").select("key", "target").distinct().withColumn("depth", F.lit(1))
    paths = written(links)
    n = paths.count()
    while n:
        onward = paths.select(F.col("key").alias("target"), F.col("target").alias("far"), F.col("depth").alias("more"))
        longer = paths.join(onward, "target").select("key", F.col("far").alias("target"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = written(paths.unionByName(longer).groupBy("key", "target").agg(F.min("depth").alias("depth")))
        before, n = n, paths.count()
        if n == before:
            break
    return paths


def dereference(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, key, depth, found``: all keys a root reaches through ``edges (key, target)``, each by its shortest way.

    What a key reaches is resolved once for all roots (``reach``), however deep; the roots join last. ``found`` tells
    whether the key exists (is the key of an edge row; leaves carry a null target).
    """
    direct = roots.select("root", "key").where("key IS NOT NULL").distinct()
    far = direct.join(reach(edges), "key").select("root", F.col("target").alias("key"), (F.col("depth") + 1).alias("depth"))
    all_ = direct.withColumn("depth", F.lit(1)).unionByName(far).groupBy("root", "key").agg(F.min("depth").alias("depth"))
    known = edges.select("key").distinct().withColumn("__known", F.lit(True))
    return all_.join(known, "key", "left").select("root", "key", "depth", F.coalesce("__known", F.lit(False)).alias("found"))


def expand_shared(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows (form, section_ord, section, seq, kind, text, group_label, shared_key)`` with every reference replaced by its block.

    ``blocks (key, seq, kind, text, group_label, shared_key)`` may hold references too: they are followed level by
    level until none is left. A reference to no block, or back into a block it stands in, stays as a row of kind
    ``unresolved`` with its key as text. ``seq`` is counted anew, from 0, in each ``section_ord`` of a form.
    """
    held = ["kind", "text", "group_label", "shared_key"]
    inner = blocks.select(F.col("key").alias("__k"), F.col("seq").alias("__s"), *[F.col(c).alias(f"__{c}") for c in held])
    out = rows.select("form", "section_ord", "section", F.array("seq").alias("place"), F.expr("cast(array() as array<string>)").alias("trail"), *held)
    shared = F.col("kind").eqNullSafe("shared")
    done, pending = out.where(~shared), checkpoint(out.where(shared))
    while not pending.isEmpty():
        looped = F.array_contains("trail", F.coalesce("shared_key", F.lit("")))
        step = pending.join(inner, (F.col("shared_key") == F.col("__k")) & ~looped, "left")
        lost = step.where("__k IS NULL").select("form", "section_ord", "section", "place", "trail", F.lit("unresolved").alias("kind"), F.col("shared_key").alias("text"), "group_label", "shared_key")
        found = step.where("__k IS NOT NULL").select(
            "form", "section_ord", "section", F.concat("place", F.array("__s")).alias("place"), F.concat("trail", F.array("shared_key")).alias("trail"), *[F.col(f"__{c}").alias(c) for c in held]
        )
        both = checkpoint(found.unionByName(lost))
        done, pending = done.unionByName(both.where(~shared)), both.where(shared)
    w = Window.partitionBy("form", "section_ord").orderBy("section", "place", "kind", "text")
    return done.withColumn("seq", F.row_number().over(w) - 1).select("form", "section_ord", "section", "seq", "kind", "text", "group_label")


def runs(df: DataFrame, part: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Each row with ``run``: the number of its stretch of equal ``same`` values within the part, from 1."""
    w = Window.partitionBy(*part).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", (changed | first).cast("int")).withColumn("run", F.sum("__new").over(w)).drop("__new")


def merge_runs(df: DataFrame, part: list[str], order: list[str], same: str, text: str, sep: str = "\n") -> DataFrame:
    """One row per run of equal ``same``: its texts joined in order, and how many there were."""
    marked = runs(df, part, order, [same])
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    joined = F.array_join(F.transform(items, lambda x: x["t"]), sep)
    return marked.groupBy(*part, "run", same).agg(joined.alias(text), F.count("*").alias("merged"))


def merge_segments(df: DataFrame, part: list[str], order: list[str], structural: str = r"(?i)^or\b|one of the following|(?:morning|evening)\s+prayer\s+continues", unfinished: str = r"(?i)(?:morning|evening)\s+prayer\s+continues|continues$") -> DataFrame:
    """Same-kind neighbours merged left to right with a line break.

    A rubric that matches ``structural`` begins a segment of its own and takes nothing in, but for a bare ``Or``, which takes its
    name, and for a sentence that matches ``unfinished`` without a full stop at its end, which takes its rest with a blank. Blank segments go at the end.
    What was merged is looked at again before the next, so this is a fold over each part, in pandas.
    """
    divides, open_ = re.compile(structural), re.compile(unfinished)
    cols = [*part, "kind", "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields) + ", seq int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out: list[list] = []
        for kind, text in zip(pdf["kind"], pdf["text"]):
            text = text or ""
            if out and out[-1][0] == kind:
                last = out[-1][1]
                bare = kind == "rubric" and last.strip().lower() == "or"
                begun = kind == "rubric" and bool(open_.search(last)) and not last.rstrip().endswith(".")
                if kind != "rubric" or not (divides.search(text) or (divides.search(last) and not bare and not begun)):
                    out[-1][1] = last + (" " if begun else "\n") + text
                    continue
            out.append([kind, text])
        out = [x for x in out if x[1].strip()]
        rows = pd.DataFrame(out, columns=["kind", "text"])
        for c in part[::-1]:
            rows.insert(0, c, pdf[c].iloc[0])
        rows["seq"] = range(len(rows))
        return rows

    return df.groupBy(*part).applyInPandas(fold, schema)


def alternation_breaks(df: DataFrame, part: list[str], order: list[str], group: str) -> DataFrame:
    """The first two neighbouring segments of one kind that are no rubrics, in each part; a change of group resets."""
    spoken = runs(df, part, order, [group]).where("kind <> 'rubric'")
    w = Window.partitionBy(*part, "run").orderBy(*order)
    hits = spoken.withColumn("__p", F.lag("kind").over(w)).where("kind = __p").drop("__p")
    first = Window.partitionBy(*part).orderBy("run", *order)
    return hits.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def forward_fill(df: DataFrame, part: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """``name``: the last marker at or before each row, in parts of any size. ``order`` begins with a number, date or time."""
    return last_known(df, part, order, marker, name)


def period_pick(df: DataFrame, part: list[str], order: list[str], marker: Column, header: Column, index: Column) -> DataFrame:
    """The rows of one period of a list that markers divide.

    Content before the first marker is week 0 and the markers are weeks 1 to n, else they are weeks 0 to n-1; the index
    is held within the periods, headers always stay, and without markers everything does.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    whole = Window.partitionBy(*part)
    out = df.withColumn("__m", F.coalesce(marker, F.lit(False))).withColumn("__h", F.coalesce(header, F.lit(False)))
    out = out.withColumn("__g", F.sum(F.col("__m").cast("int")).over(w)).withColumn("__n", F.max("__g").over(whole))
    out = out.withColumn("__zero", F.max((F.col("__g") == 0) & ~F.col("__h")).over(whole))
    want = F.greatest(index, F.lit(0))
    want = F.when(F.col("__zero"), F.least(want, F.col("__n"))).otherwise(F.least(want + 1, F.col("__n")))
    keep = (F.col("__n") == 0) | ((F.col("__g") == 0) & F.col("__h")) | (F.col("__g") == want)
    return out.where(keep).drop("__m", "__h", "__g", "__n", "__zero")


def continuation_lines(df: DataFrame, part: list[str], order: list[str], text: str) -> DataFrame:
    """Verse lines with ``continued``: opened by a blank, or after a line that ends in ``*``; blank lines reset, runs of them are one, none at the ends."""
    w = Window.partitionBy(*part).orderBy(*order)
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    out = df.withColumn("__b", blank).withColumn("__pb", F.lag("__b", 1, True).over(w))
    out = out.withColumn("__rest", F.min("__b").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("__pt", F.lag(F.rtrim(text)).over(w))
    kept = out.where("NOT (__b AND (__pb OR __rest))")
    continued = ~F.col("__b") & (F.col(text).startswith(" ") | F.coalesce(F.col("__pt").endswith("*"), F.lit(False)))
    return kept.withColumn("continued", continued).drop("__b", "__pb", "__rest", "__pt")


def trailing_rubrics(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Each row with ``trailing``: a rubric after which only rubrics come."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("trailing", F.min(F.col("kind") == "rubric").over(w))


def split_at(df: DataFrame, part: list[str], order: list[str], cue: Column) -> DataFrame:
    """Each row with ``after``: is the first row that meets ``cue`` at or before it? False everywhere without one."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("after", F.max(F.coalesce(cue, F.lit(False))).over(w))


def reposition(df: DataFrame, part: list[str], order: list[str], moved: Column, last: bool = False) -> DataFrame:
    """A new gap-free ``seq`` in which the rows that meet ``moved`` come first (or last), both in their old order."""
    w = Window.partitionBy(*part).orderBy((moved if last else ~moved), *order)
    return df.withColumn("seq", F.row_number().over(w) - 1)


def group_alternatives(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Rows divided by ``Or`` lines into numbered groups: ``group_no`` from 1 and a label, roman where the line names none."""
    w = Window.partitionBy(*part).orderBy(*order)
    sep = (F.col("kind").isin("rubric", "label")) & F.col("text").rlike(r"(?i)^or\b[ :]?[^a-z]*$|^Or [A-Z].*$")
    out = df.withColumn("__sep", F.coalesce(sep, F.lit(False)))
    out = out.withColumn("group_no", F.sum(F.col("__sep").cast("int")).over(w) + 1)
    named = F.when(F.col("__sep"), F.nullif(F.trim(F.regexp_replace("text", r"(?i)^or\b[ :]*", "")), F.lit("")))
    label = F.first(named, ignorenulls=True).over(Window.partitionBy(*part, "group_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("label", F.coalesce(label, roman(F.col("group_no")))).where("NOT __sep").drop("__sep")


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3,999."""
    digit = lambda d, one, five, ten: F.element_at(
        F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d + 1).cast("int")
    )
    n = n.cast("int")
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(F.floor(n / 100) % 10, "C", "D", "M"), digit(F.floor(n / 10) % 10, "X", "L", "C"), digit(n % 10, "I", "V", "X"))


def first_copies(blocks: DataFrame, key: str, order: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """Shared blocks hoisted by key: the first copy of each, and the later copies whose squashed content differs."""
    signed = blocks.withColumn("__sig", F.sha2(F.regexp_replace(content, r"(?U)\s+", " "), 256))
    place = F.struct(*order)
    first = signed.groupBy(F.col(key).alias("__k")).agg(F.min_by("__sig", place).alias("__f"), F.min(place).alias("__p"))
    marked = signed.join(first, F.col(key).eqNullSafe(F.col("__k"))).withColumn("__first", place.eqNullSafe(F.col("__p")))
    spare = ["__k", "__f", "__p", "__sig", "__first"]
    return marked.where("__first").drop(*spare), marked.where("NOT __first AND NOT (__sig <=> __f)").drop(*spare)


def header(df: DataFrame, part: list[str], order: list[str], kind: str = "kind", text: str = "text") -> DataFrame:
    """``part, title, subtitle``: the first heading of every part, and the leader lines between it and the next heading, two at most."""
    heading, place = F.col(kind) == "heading", F.struct(*order)
    first = df.groupBy(*part).agg(F.min_by(F.when(heading, F.col(text)), F.when(heading, place)).alias("title"), F.min(F.when(heading, place)).alias("__a"))
    after = df.join(first, part).where(place > F.col("__a"))
    ends = after.groupBy(*part).agg(F.min(F.when(heading, place)).alias("__z"))
    between = after.join(ends, part).where((F.col(kind) == "leader") & (F.col("__z").isNull() | (place < F.col("__z"))))
    ranked = between.withColumn("__r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("__r <= 2")
    sub = ranked.groupBy(*part).agg(F.concat_ws(" ", F.max(F.when(F.col("__r") == 1, F.col(text))), F.max(F.when(F.col("__r") == 2, F.col(text)))).alias("subtitle"))
    return first.where("title IS NOT NULL").drop("__a").join(sub, part, "left")
