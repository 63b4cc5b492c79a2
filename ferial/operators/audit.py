"""Audits: peer outliers, minorities, repeats, integrity, waivers, conservation, multiset differences, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.functions.text import squash
from ferial.operators.conserve import found_in
from ferial.operators.lookup import verses_in_ranges

# fixed values: what a finding costs
PENALTY = {1: 10, 2: 3, 3: 5}


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Each row with aggregates of its group, by an aggregate (combined on the map side) and a join: a hot group is never
    gathered in one task as a window would. Null keys are a group."""
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    s = df.groupBy(*renamed).agg(*[c.alias(n) for n, c in stats.items()])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(s, same).drop(*[f"__k{i}" for i in range(len(keys))])


def peer_zscore(df: DataFrame, peer: list[str], value: str, most: float = 2.0) -> DataFrame:
    """Rows whose value lies more than ``most`` population deviations from their peers' mean, with ``z`` to one decimal; a value of 0
    among peers with a positive mean always stands out (``z`` is null), any other 0 never.

    Alone, or where all are equal, nothing lies apart; nulls are no peers.
    """
    out = with_stats(df, peer, __n=F.count(value), __m=F.avg(value), __s=F.stddev_pop(value)).where("__n > 1 AND __s > 0")
    z = F.abs(F.col(value) - F.col("__m")) / F.col("__s")
    zero = F.col(value) == 0
    out = out.where((zero & (F.col("__m") > 0)) | (~zero & (z > most)))
    return out.withColumn("z", F.when(~zero, F.round(z, 1))).drop("__n", "__m", "__s")


def boolean_minority(df: DataFrame, peer: list[str], flag: str, most: int = 2) -> DataFrame:
    """Rows on the rarer side of a flag that both sides of their peers show, where at most ``most`` are on it; on a tie ``true`` is rarer."""
    out = with_stats(df, peer, __y=F.count_if(F.col(flag)), __n=F.count_if(~F.col(flag)))
    out = out.where((F.least("__y", "__n") > 0) & (F.least("__y", "__n") <= most))
    return out.where(F.col(flag) != (F.col("__y") > F.col("__n"))).drop("__y", "__n")


def repeats_within(df: DataFrame, unit: str, text: str) -> DataFrame:
    return df.groupBy(unit, text).agg(F.count("*").alias("times")).where("times > 1")


def singletons(df: DataFrame, unit: str, text: str) -> DataFrame:
    """Texts that stand in exactly one unit, and which; two longs of state a text instead of a set of units."""
    return df.groupBy(text).agg(F.min(unit).alias(unit), F.max(unit).alias("__m")).where(F.col(unit) == F.col("__m")).drop("__m")


def lonely_cues(segments: DataFrame, unit: str, part: list[str], order: list[str], shared: str) -> DataFrame:
    """``unit, text`` of rubrics right before a reference to the block ``shared`` whose wording only one unit has."""
    before = Window.partitionBy(unit, *part).orderBy(*order)
    held = segments.withColumn("__k", F.lag("kind").over(before)).withColumn("__t", F.lag("text").over(before))
    return singletons(held.where((F.col("shared_key") == shared) & (F.col("__k") == "rubric") & F.col("__t").isNotNull()).select(unit, F.col("__t").alias("text")), unit, "text").select(unit, "text")


def penalty_scores(failures: DataFrame, outliers: DataFrame | None = None, exempt: DataFrame | None = None, unresolved: DataFrame | None = None, unit: str = "form") -> DataFrame:
    """``unit, score``: 100 less all penalties of a unit, at least 0.

    ``failures (unit, tier)`` cost by tier; ``outliers (unit, metric, z, flag)`` by their distance (15 from 3.0 on, else 5, also
    where z is null because the value is 0) or, where ``flag`` is true, 5 for standing alone with it, nothing if
    ``exempt (unit, metric)`` names them; a day that did not resolve or a render that failed (``unresolved (unit)``) 100. A
    unit whose findings are all exempt scores 100; findings without a unit count for ``__global__``.
    """
    key = F.coalesce(F.col(unit), F.lit("__global__")).alias(unit)
    tier = F.coalesce(*[F.when(F.col("tier") == t, p) for t, p in PENALTY.items()], F.lit(0))
    parts = [failures.select(key, tier.alias("cost"))]
    if outliers is not None:
        known = (exempt if exempt is not None else outliers.limit(0)).select(F.col(unit).alias("__u"), F.col("metric").alias("__m")).distinct().withColumn("__x", F.lit(True))
        cost = F.when(F.coalesce("__x", F.lit(False)), 0).when(F.coalesce(F.col("z") >= 3.0, F.lit(False)) & ~F.col("flag"), 15).otherwise(5)
        parts.append(outliers.join(known, (F.col(unit) == F.col("__u")) & (F.col("metric") == F.col("__m")), "left").select(key, cost.alias("cost")))
    if unresolved is not None:
        parts.append(unresolved.select(key, F.lit(100).alias("cost")))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(unit).agg(F.greatest(F.lit(0), 100 - F.sum("cost")).cast("bigint").alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    """The least score, 100 without any."""
    return scores.agg(F.coalesce(F.min("score"), F.lit(100)).cast("bigint").alias("score"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """``rule, id`` for child keys without a parent; nulls refer to nothing."""
    keys = child.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("id")).distinct()
    found = keys.join(parent.select(F.col(parent_key).alias("id")), "id", "left_anti")
    return found.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"))


def waivers(findings: DataFrame, licensed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, outcome``: waived, fail (not licensed) or stale (licensed, but it no longer fires)."""
    a = findings.select(*keys).distinct().withColumn("__f", F.lit(True))
    b = licensed.select(*keys).distinct().withColumn("__w", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("__f") & F.col("__w"), "waived").when(F.col("__f"), "fail").otherwise("stale").alias("outcome"))


def baseline(findings: DataFrame, known: DataFrame, keys: list[str], count: str = "lines") -> DataFrame:
    """``keys, found, expected, outcome``: known (equal), stale (gone), count (another number) or new."""
    got = findings.groupBy(*keys).agg(F.count("*").alias("found"))
    both = got.join(known.select(*keys, F.col(count).cast("bigint").alias("expected")), keys, "full_outer")
    both = both.na.fill(0, ["found"])
    outcome = F.when(F.col("expected").isNull(), "new").when(F.col("found") == 0, "stale").when(F.col("found") != F.col("expected"), "count").otherwise("known")
    return both.select(*keys, "found", F.coalesce("expected", F.lit(0)).alias("expected"), outcome.alias("outcome"))


def unclaimed(findings: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline by membership only: ``keys, outcome`` of findings nobody claimed (new) and of claims without a finding (stale)."""
    a, b = findings.select(*keys).distinct(), known.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("outcome", F.lit("new")).unionByName(b.join(a, keys, "left_anti").withColumn("outcome", F.lit("stale")))


def empty_ranges(ranges: DataFrame, verses: DataFrame, id_col: str) -> DataFrame:
    """Ids of ranges ``(id, book, start_ch, start_v, end_ch, end_v)`` that hold no verse: unknown book, no such place, or reversed."""
    return ranges.join(verses_in_ranges(ranges, verses).select(id_col).distinct(), id_col, "left_anti").select(id_col)


def conservation(left: DataFrame, right: DataFrame, unit: str, text: str) -> DataFrame:
    """Every line of ``left`` with the first rule that accounts for it in ``right`` of the same unit: verbatim, whitespace
    (equal when squashed), part (inside a line) or unaccounted. Exact rules are equi joins; what they leave is searched for by
    ``conserve.found_in``."""
    l = left.select(F.col(unit).alias("unit"), F.col(text).alias("line")).where("line IS NOT NULL").groupBy("unit", "line").agg(F.count("*").alias("n"))
    r = right.select(F.col(unit).alias("unit"), F.col(text).alias("other")).where("other IS NOT NULL").distinct()
    exact = r.select("unit", F.col("other").alias("line"), F.lit(True).alias("__v"))
    near = r.select("unit", squash(F.col("other")).alias("__s")).distinct().withColumn("__w", F.lit(True))
    marked = l.join(exact, ["unit", "line"], "left").withColumn("__s", squash(F.col("line"))).join(near, ["unit", "__s"], "left")
    done = marked.where("__v OR __w").select("unit", "line", "n", F.when(F.col("__v"), "verbatim").otherwise("whitespace").alias("rule"))
    open_ = marked.where("__v IS NULL AND __w IS NULL").select("unit", "line", "n", "__s")
    inside = found_in(r.select("unit", squash(F.col("other")).alias("h")), open_.select("unit", F.col("__s").alias("n"))).select("unit", F.col("n").alias("__s"), F.lit(True).alias("__p"))
    rest = open_.join(inside, ["unit", "__s"], "left").select("unit", "line", "n", F.when(F.col("__p"), "part").otherwise("unaccounted").alias("rule"))
    return done.unionByName(rest)


def multiset_diff(before: DataFrame, after: DataFrame, part: list[str], cols: list[str]) -> DataFrame:
    """``part, old, new, change`` by pairing what each side has more of, in sorted order: modified, removed or added."""
    names = [*part, *cols]

    def left_over(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*cols)
        more = a.select(*names).exceptAll(b.select(*names))
        return more.withColumn("__r", F.row_number().over(w)).select(*part, "__r", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias(name))

    both = left_over(before, after, "old").join(left_over(after, before, "new"), [*part, "__r"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return both.select(*part, "old", "new", change.alias("change"))


def moved(before: DataFrame, after: DataFrame, part: list[str], order: str, cols: list[str]) -> DataFrame:
    """Parts that hold the same rows in another order."""
    both = before.withColumn("__side", F.lit(0)).unionByName(after.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    row = F.xxhash64(*cols, *[F.col(c).isNull() for c in cols])
    w = Window.partitionBy(*part, "__side").orderBy(order)
    placed = both.withColumn("__h", row).withColumn("__i", F.row_number().over(w))
    sums = placed.groupBy(*part).agg(
        *[f(F.when(F.col("__side") == s, v)).alias(f"{n}{s}") for s in (0, 1) for n, f, v in (("n", F.count, F.col("__h")), ("bag", F.bit_xor, F.xxhash64("__h")), ("seq", F.bit_xor, F.xxhash64("__h", "__i")), ("sum", F.sum, (F.col("__h") / 4096).cast("decimal(38,0)")))]
    )
    return sums.where("n0 = n1 AND bag0 = bag1 AND sum0 = sum1 AND seq0 <> seq1").select(*part)


def nearest_rank(df: DataFrame, part: list[str], value: str, q: float) -> DataFrame:
    """The value at place ⌊q·n⌋ (from 0) of the sorted values, exactly.

    Approximate cut points divide every part into 64 buckets; their counts tell which one holds the place, and only
    that bucket is ranked, so no part is sorted as a whole.
    """
    known = df.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("__x"))
    cuts = known.groupBy(*part).agg(F.percentile_approx("__x", [i / 64 for i in range(1, 64)], 10_000).alias("__c"), F.count("*").alias("__n"))
    placed = known.join(cuts, part).withColumn("__b", F.size(F.filter("__c", lambda c: c < F.col("__x"))))
    w = Window.partitionBy(*part).orderBy("__b")  # at most 64 rows
    counts = placed.groupBy(*part, "__b", "__n").agg(F.count("*").alias("__k")).withColumn("__before", F.sum("__k").over(w) - F.col("__k"))
    want = F.least(F.floor(F.col("__n") * q), F.col("__n") - 1) - F.col("__before")
    hit = counts.withColumn("__want", want).where("__want >= 0 AND __want < __k").select(*part, "__b", "__want")
    rows = placed.drop("__c", "__n").join(hit, [*part, "__b"])
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*part, "__b").orderBy("__x")) - 1)
    return ranked.where("__r = __want").select(*part, F.col("__x").alias("quantile"))


def collision_keys(df: DataFrame, name: str, detail: str, date: str) -> DataFrame:
    """``key``: the name where it is unique, else with its detail, else (without one) its date."""
    detailed = F.when(F.trim(F.coalesce(F.col(detail), F.lit(""))) != "", F.concat_ws(", ", name, detail)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col(date), F.lit(")")))
    out = with_stats(df, [name], __n=F.count("*"))
    return out.withColumn("key", F.when(F.col("__n") == 1, F.col(name)).otherwise(detailed)).drop("__n")


def worst(df: DataFrame, unit: str, count: str, k: int = 5) -> DataFrame:
    return df.orderBy(F.col(count).desc(), F.col(unit).desc()).limit(k)


def duplicates(df: DataFrame, id_col: str, content: Column) -> DataFrame:
    """Rows whose normalised content an earlier id has: ``id, first_id``."""
    signed = df.select(F.col(id_col).alias("id"), F.sha2(content, 256).alias("__s")).where("__s IS NOT NULL").distinct()
    first = signed.groupBy("__s").agg(F.min("id").alias("first_id"), F.max("id").alias("__m")).where("first_id <> __m").drop("__m")
    return signed.join(first, "__s").where("id <> first_id").select("id", "first_id")


def bucketed_lines(df: DataFrame, line: str, buckets: list[tuple[str, Column]], rest: str) -> DataFrame:
    """``bucket, lines``: how many lines fall in each bucket, the first whose test a line meets, else ``rest``."""
    out = None
    for name, test in buckets:
        hit = F.coalesce(test, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return df.where(F.col(line).isNotNull()).groupBy((F.lit(rest) if out is None else out.otherwise(rest)).alias("bucket")).agg(F.count("*").alias("lines"))


def parity(left: DataFrame, right: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """``keys, left, right`` where the rows of the two sides differ in number by more than ``most``."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(left, "left").join(n(right, "right"), keys, "full_outer").na.fill(0, ["left", "right"])
    return both.where(F.abs(F.col("left") - F.col("right")) > most)


def chapter_ends(verses: DataFrame) -> DataFrame:
    """``book, ch, first_v, last_v`` of every chapter."""
    return verses.groupBy("book", "ch").agg(F.min("v").alias("first_v"), F.max("v").alias("last_v"))


def next_older(names: DataFrame, name: str, current: str) -> DataFrame:
    """The greatest name before ``current``; null without one."""
    return names.agg(F.max(F.when(F.col(name) < current, F.col(name))).alias(name))


@dataclass(frozen=True)
class Rule:
    """A rule over the segments of a form: it fires where ``broken`` (an aggregate over them) is true."""

    name: str
    tier: int
    broken: Column


def run_rules(segments: DataFrame, unit: str, rules: list[Rule]) -> DataFrame:
    """``unit, rule, tier`` of all rules that fire; one aggregation for all of them."""
    out = segments.groupBy(unit).agg(*[r.broken.alias(f"r{i}") for i, r in enumerate(rules)])
    fired = F.array(*[F.when(F.col(f"r{i}"), F.struct(F.lit(r.name).alias("rule"), F.lit(r.tier).alias("tier"))) for i, r in enumerate(rules)])
    return out.select(unit, F.inline(F.array_compact(fired)))


def required_missing(have: DataFrame, unit: str, section: str, required: list[str]) -> DataFrame:
    """``unit, section`` for every required section a unit lacks; the required names are few and given."""
    present = have.groupBy(unit).agg(F.collect_set(F.when(F.col(section).isin(required), F.col(section))).alias("__has"))
    wanted = F.array(*[F.lit(x) for x in required])
    return present.select(unit, F.explode(F.array_except(wanted, F.col("__has"))).alias(section))


class GateError(ValueError):
    """Blocking findings; nothing was written. ``findings`` holds all of them as JSON, the message the first hundred."""

    def __init__(self, findings: DataFrame):
        super().__init__(f"{findings.count()} findings: " + "; ".join(r[0] for r in findings.orderBy("finding").take(100)))
        self.findings = findings


def all_findings(findings: list[DataFrame]) -> DataFrame | None:
    """``finding``: every row of every audit as JSON."""
    total = None
    for f in findings:
        f = f.select(F.to_json(F.struct("*")).alias("finding"))
        total = f if total is None else total.unionByName(f)
    return total


def gate(findings: list[DataFrame]) -> None:
    """Raises if any of the findings has a row; all are looked at before anything is written."""
    total = all_findings(findings)
    if total is not None and not total.isEmpty():
        raise GateError(total)
