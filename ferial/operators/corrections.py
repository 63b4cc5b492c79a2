"""Corrections applied as checked merges: occurrence counts, misses, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.functions.text import occurrences

#: corrections of every row (``*``) that go to a task at once
MAX_CORRECTIONS = 100_000


class CorrectionError(ValueError):
    """Corrections that do not match; ``misses`` holds all of them as rows, the message the first five."""

    def __init__(self, misses: DataFrame):
        super().__init__(f"{misses.count()} corrections did not match, first: {[tuple(r) for r in misses.orderBy('id').take(5)]}")
        self.misses = misses


def _blocks(corrections: DataFrame, key: str) -> list[DataFrame]:
    """The corrections in blocks of rising ``ord`` with at most ``MAX_CORRECTIONS`` of every row in each (more only where they share one ``ord``)."""
    anywhere = corrections.where(F.col(key) == "*")
    n = anywhere.count()
    if n <= MAX_CORRECTIONS:
        return [corrections]
    many = -(-n // MAX_CORRECTIONS)
    # few and evenly spread: the cut points only decide where a block ends
    cuts = sorted(set(anywhere.select(F.percentile_approx("ord", [i / many for i in range(1, many)] or [0.5], 10_000)).first()[0]))
    ends = [None, *cuts, None]
    inside = lambda a, b: (F.lit(True) if a is None else F.col("ord") > a) & (F.lit(True) if b is None else F.col("ord") <= b)
    return [corrections.where(inside(a, b)) for a, b in zip(ends, ends[1:])]


def _targets(rows: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Rows with the corrections that aim at them: by ``key``, or at every row where it is ``*``, which never reaches keys
    that begin with an underscore. Those of every row are a block (``_blocks``), so their number is bounded."""
    c = corrections.select(F.col("id").alias("c_id"), F.col(key).alias("c_key"), "ord", "old", "new")
    named = rows.join(c, F.col(key) == F.col("c_key"))
    anywhere = rows.join(F.broadcast(c.where("c_key = '*'")), ~F.col(key).startswith("_"))
    return named.unionByName(anywhere)


def apply_replacements(rows: DataFrame, corrections: DataFrame, key: str, row_id: str, text: str) -> DataFrame:
    """``rows`` with ``text`` corrected by ``corrections (id, <key>, ord, old, new)``: every occurrence of ``old``, one
    correction after the other, so that a later one sees what an earlier one wrote. ``row_id`` identifies a row."""
    for block in _blocks(corrections, key):
        steps = _targets(rows, block, key).groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("ord", "old", "new"))).alias("__steps"))
        out = rows.join(steps, row_id, "left")
        fixed = F.aggregate(F.col("__steps"), F.col(text), lambda acc, s: F.replace(acc, s["old"], s["new"]))
        rows = out.withColumn(text, F.when(F.col("__steps").isNull(), F.col(text)).otherwise(fixed)).drop("__steps")
    return rows


def occurrence_check(rows: DataFrame, corrections: DataFrame, key: str, text: str) -> DataFrame:
    """Per correction ``id, wanted, found, outcome``: ok, miss (none found) or count (another number than ``count``, 1 by default)."""
    found_in = F.sum(occurrences(F.coalesce(F.col(text), F.lit("")), F.col("old"))).alias("found")
    hits = None
    for block in _blocks(corrections, key):
        part = _targets(rows, block, key).groupBy("c_id").agg(found_in)
        hits = part if hits is None else hits.unionByName(part)
    out = corrections.join(hits, F.col("id") == F.col("c_id"), "left")
    wanted, found = F.coalesce(F.col("count"), F.lit(1)).cast("bigint"), F.coalesce("found", F.lit(0)).cast("bigint")
    outcome = F.when(found == 0, "miss").when(found != wanted, "count").otherwise("ok")
    return out.select("id", wanted.alias("wanted"), found.alias("found"), outcome.alias("outcome"))


def apply_checked(rows: DataFrame, corrections: DataFrame, key: str, row_id: str, text: str) -> DataFrame:
    """Applies all or none: every correction is judged before anything is returned."""
    bad = occurrence_check(rows, corrections, key, text).where("outcome <> 'ok'")
    if not bad.isEmpty():
        raise CorrectionError(bad)
    return apply_replacements(rows, corrections, key, row_id, text)


def first_occurrence(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first ``old`` replaced, unchanged where it holds none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def replace_equal(rows: DataFrame, corrections: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` becomes ``new`` where it is null-safely equal to ``old`` of the correction with the same keys; ``outcome`` says what happened."""
    c = corrections.select(*keys, F.col("old").alias("__old"), F.col("new").alias("__new"), F.lit(True).alias("__c"))
    out = rows.join(c, keys, "left")
    hit = F.col("__c") & F.col(value).eqNullSafe(F.col("__old"))
    outcome = F.when(F.col("__c").isNull(), "untouched").when(hit, "applied").otherwise("stale")
    return out.withColumn("outcome", outcome).withColumn(value, F.when(F.coalesce(hit, F.lit(False)), F.col("__new")).otherwise(F.col(value))).drop("__old", "__new", "__c")


def replace_first(rows: DataFrame, corrections: DataFrame, keys: list[str], text: str, stamps: str) -> DataFrame:
    """``rows`` with the first ``old`` of ``text`` replaced by the correction ``(keys…, id, old, new, reason)`` of its key, and the id
    appended to the array ``stamps`` where the correction gives a reason. ``outcome``: applied, miss (``old`` not there) or untouched."""
    c = corrections.select(*keys, F.col("id").alias("__id"), F.col("old").alias("__old"), F.col("new").alias("__new"), F.col("reason").alias("__why"))
    out = rows.join(c, keys, "left")
    hit = F.coalesce(F.instr(F.col(text), F.col("__old")) > 0, F.lit(False))
    outcome = F.when(F.col("__id").isNull(), "untouched").when(hit, "applied").otherwise("miss")
    held = F.coalesce(F.col(stamps), F.expr("cast(array() as array<string>)"))
    stamped = F.when(hit & (F.trim(F.coalesce("__why", F.lit(""))) != ""), F.array_append(held, F.col("__id"))).otherwise(F.col(stamps))
    out = out.withColumn("outcome", outcome).withColumn(stamps, stamped)
    return out.withColumn(text, F.when(hit, first_occurrence(F.col(text), F.col("__old"), F.col("__new"))).otherwise(F.col(text))).drop("__id", "__old", "__new", "__why")


def replace_at(rows: DataFrame, corrections: DataFrame, keys: list[str], items: str) -> DataFrame:
    """``rows`` with the member ``idx`` (from 0) of the array ``items`` replaced by ``new`` where it equals ``old`` of the correction ``(keys…,
    idx, old, new)``; several corrections of a row aim at different places. ``misses`` are the places out of range or with another value."""
    c = corrections.groupBy(*keys).agg(F.collect_list(F.struct("idx", "old", "new")).alias("__c"))  # corrections of one row: few
    out = rows.join(c, keys, "left")
    fits = lambda x: F.try_element_at(F.col(items), x["idx"] + 1).eqNullSafe(x["old"]) & (x["idx"] >= 0) & (x["idx"] < F.size(items))
    new = lambda v, i: F.coalesce(F.try_element_at(F.filter("__c", lambda x: (x["idx"] == i) & fits(x)), F.lit(1)).getField("new"), v)
    misses = F.transform(F.filter("__c", lambda x: ~F.coalesce(fits(x), F.lit(False))), lambda x: x["idx"])
    out = out.withColumn("misses", F.coalesce(misses, F.expr("cast(array() as array<int>)")))
    return out.withColumn(items, F.when(F.col("__c").isNull(), F.col(items)).otherwise(F.transform(F.col(items), new))).drop("__c")


def stale_checks(corrections: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``id, outcome`` of every correction ``(id, keys…, old)`` against the text it aims at, before any is applied: ok (``old`` stands there),
    blank (it does but for non-breaking blanks), stale, or no target."""
    t = targets.select(*keys, F.col(value).alias("__v"), F.lit(True).alias("__t"))
    plain = lambda c: F.translate(c, "\u00a0\u202f\u2007", "   ")
    has = F.contains(F.coalesce("__v", F.lit("")), F.col("old"))
    near = F.contains(plain(F.coalesce("__v", F.lit(""))), plain(F.col("old")))
    outcome = F.when(F.col("__t").isNull(), "no target").when(has, "ok").when(near, "blank").otherwise("stale")
    return corrections.join(t, keys, "left").select("id", outcome.alias("outcome"))


def refusals(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """``id, problem`` of corrections ``(id, form, section, old)`` that may not be applied: of every form yet of a whole field (a null ``old``), or of a
    field that only refers to a shared block (``fields (form, section, shared_key)``), with the block to correct instead."""
    wild = corrections.where("form = '*' AND old IS NULL").select("id", F.lit("whole field of every form").alias("problem"))
    shared = fields.where("shared_key IS NOT NULL").select("form", "section", "shared_key").distinct()
    through = corrections.join(shared, ["form", "section"]).select("id", F.concat(F.lit("correct _shared."), "shared_key").alias("problem"))
    return wild.unionByName(through)


def uncited(corrections: DataFrame, decisions: DataFrame, source: str) -> DataFrame:
    """``id, problem``: corrections that cite a decision which does not exist, or come from ``source`` and cite none."""
    d = decisions.select(F.col("number").alias("decision")).distinct()
    lost = corrections.where("decision IS NOT NULL").join(d, "decision", "left_anti").select("id", F.lit("unknown decision").alias("problem"))
    return lost.unionByName(corrections.where((F.col("source") == source) & F.col("decision").isNull()).select("id", F.lit("no decision").alias("problem")))


def unmatched(rows: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections whose target does not exist."""
    return corrections.join(rows.select(*keys).distinct(), keys, "left_anti")


def provenance(corrections: DataFrame, sources: list[str]) -> DataFrame:
    """``id, problem`` for missing and repeated ids, unknown sources and blank reasons."""
    counted = corrections.withColumn("__n", F.count("*").over(Window.partitionBy("id")))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    problems = [
        F.when(blank("id"), "no id"), F.when(~blank("id") & (F.col("__n") > 1), "repeated id"),
        F.when(~F.coalesce(F.col("source"), F.lit("")).isin(*sources), "unknown source"), F.when(blank("reason"), "no reason"),
    ]
    return counted.select("id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def shared_users(corrections: DataFrame, refs: DataFrame) -> DataFrame:
    """A correction of a shared block stands for every form that refers to it: ``id, form``."""
    return corrections.join(refs.select(F.col("shared_key").alias("key"), "form").distinct(), "key").select("id", "form")
