"""Periods of the year: as-of joins over small interval tables, gaps, neighbours and occurrences."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.operators.hot import row_at
from ferial.runtime import small

# fixed values: the periods by the bound that opens them, in order of the year. Ordinary time opens the day after Trinity.
SEASONS = (
    ("advent_i", "Advent"), ("christmas", "Christmas"), ("epiphany", "Epiphany"), ("ash_wednesday", "Lent"), ("passiontide", "Passiontide"),
    ("easter", "Easter"), ("pentecost", "Pentecost"), ("trinity_sunday", "OrdinaryTime"), ("all_saints", "AllSaints"), ("advent_ii", "Advent"), ("christmas_ii", "Christmas"),
)
FORM_SEASONS = (
    ("advent_i", "Advent"), ("christmas", "Christmas"), ("epiphany", "Epiphany"), ("presentation", "OrdinaryTime"), ("ash_wednesday", "Lent"),
    ("passiontide", "Passiontide"), ("easter", "Easter"), ("ascension", "Pentecost"), ("trinity_sunday", "OrdinaryTime"), ("all_saints", "AllSaints"),
    ("advent_ii", "Advent"), ("christmas_ii", "Christmas"),
)
_INSTEAD = {"passiontide": "palm_sunday", "ascension": "pentecost"}


def season_intervals(bounds: DataFrame, form: bool = False) -> DataFrame:
    """``season, start, end`` (end exclusive, null is open) of ``bounds (key, start)``; missing bounds are skipped."""
    table = FORM_SEASONS if form else SEASONS
    keys = sorted({k for k, _ in table} | set(_INSTEAD.values()))
    # one row per named bound: at most as many rows as there are keys
    found = bounds.where(F.col("key").isin(keys) & F.col("start").isNotNull()).groupBy("key").agg(F.min("start").alias("start")).collect()
    at = {r.key: r.start for r in found}
    opened = []
    for key, season in table:
        start = at.get(key) or at.get(_INSTEAD.get(key))
        if start:
            opened.append((season, start + timedelta(days=1) if key == "trinity_sunday" else start))
    # the later period of the year wins: an earlier one ends where any later one opens
    rows = []
    for i, (season, start) in enumerate(opened):
        end = min((s for _, s in opened[i + 1 :]), default=None)
        if end is None or start < end:
            rows.append((season, start, end))
    return small(bounds.sparkSession, rows, "season string, start date, end date")


def as_of(df: DataFrame, at: str, intervals: DataFrame, value: str, default: Column | None = None, max_rows: int = 10_000) -> DataFrame:
    """Each row with the ``value`` of the interval ``[start, end)`` (a null end is open) that opened last at or before ``at``.

    An interval is overtaken by the next one that opens, whether it has ended or not: where the last one opened has ended, or none
    has opened, the row has ``default``. Of intervals that open together the one that ends last counts (ties: the greatest
    value); a null start opens nothing. A table of at most ``max_rows`` intervals is broadcast (its size is counted); beyond
    that they are laid among the rows and carried forward, with the same result.
    """
    fill = default if default is not None else F.lit(None)
    if intervals.limit(max_rows + 1).count() > max_rows:
        return as_of_sorted(df, at, intervals, value, fill)
    w = Window.partitionBy(F.lit(0)).orderBy("__s")  # at most max_rows
    iv = _one_per_start(intervals, value).withColumn("__next", F.lead("__s").over(w))
    kept = [c for c in df.columns if c != value]
    hit = (F.col(f"`{at}`") >= F.col("__s")) & (F.col("__next").isNull() | (F.col(f"`{at}`") < F.col("__next")))
    open_ = F.col("__s").isNotNull() & (F.col("__e").isNull() | (F.col(f"`{at}`") < F.col("__e")))
    out = df.join(F.broadcast(iv), hit, "left").withColumn("__v", F.coalesce(F.when(open_, F.col("__v")), fill))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__v").alias(value))


def _one_per_start(intervals: DataFrame, value: str) -> DataFrame:
    last = F.max(F.struct(F.col("end").isNull().alias("o"), F.col("end").alias("e"), F.col(value).alias("v"))).alias("m")
    one = intervals.where(F.col("start").isNotNull()).groupBy(F.col("start").alias("__s")).agg(last)
    return one.select("__s", F.col("m.e").alias("__e"), F.col("m.v").alias("__v"))


def as_of_sorted(df: DataFrame, at: str, intervals: DataFrame, value: str, fill: Column) -> DataFrame:
    """``as_of`` of two large tables: both are cut at quantiles of ``at``, and the last interval is carried forward within
    each part. What opened last before a part is found by one aggregate per part, so parts work alone.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(at, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    kind = df.schema[at].dataType
    limits = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{kind.simpleString()}>")
    part = F.size(F.filter(limits, lambda c: c <= F.col("__at")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{at}`").alias("__at"), F.lit(1).alias("__kind"))
    marks = _one_per_start(intervals, value).select(F.col("__s").cast(kind).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col("__v"), F.col("__e").cast(kind).alias("__e")).alias("__m"))
    marks = marks.withColumn("__part", part)
    both = rows.withColumn("__part", part).unionByName(marks, allowMissingColumns=True)
    last = marks.groupBy("__part").agg(F.max_by("__m", "__at").alias("m"))
    every = df.sparkSession.range(len(set(cuts)) + 1).select(F.col("id").cast("int").alias("__part")).join(last, "__part", "left")
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    carried = every.select("__part", F.last("m", ignorenulls=True).over(earlier).alias("__before"))
    w = Window.partitionBy("__part").orderBy("__at", "__kind")
    held = F.coalesce(F.last("__m", ignorenulls=True).over(w), F.col("__before"))
    out = both.join(F.broadcast(carried), "__part", "left").withColumn("__held", held).where("__kind = 1")
    open_ = F.col("__held").isNotNull() & (F.col("__held.__e").isNull() | (F.col("__at") < F.col("__held.__e")))
    kept = [F.col(f"__row.`{c}`").alias(c) for c in df.columns if c != value]
    return out.select(*kept, F.coalesce(F.when(open_, F.col("__held.__v")), fill).alias(value))


def form_key(season: Column, office: Column, weekday: Column) -> Column:
    """``advent-mp``; ordinary time is kept by weekday."""
    day = F.element_at(F.array(*[F.lit(x) for x in ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")]), (weekday + 1).cast("int"))
    return F.concat_ws("-", F.when(season == "OrdinaryTime", F.concat(F.lit("ordinary-"), day)).otherwise(F.lower(season)), office)


def next_day(df: DataFrame, date: str, cols: list[str]) -> DataFrame:
    """Each row with the columns of the following date, not of the next row: dates may have gaps."""
    other = df.select(F.date_sub(date, 1).alias(date), *[F.col(c).alias(f"next_{c}") for c in cols])
    return df.join(other, date, "left")


def missing_dates(df: DataFrame, date: str) -> DataFrame:
    """Days between the first and the last that no row has."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).where("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))
    return days.join(df.select(date).distinct(), date, "left_anti")


def nth_occurrence(df: DataFrame, key: str, date: str, upto: int) -> DataFrame:
    """``key, first_1 … first_n``: the dates of the first occurrences of every key."""
    w = Window.partitionBy(key).orderBy(date)
    ranked = df.select(key, date).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= upto)
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("n") == i, F.col(date))).alias(f"occurrence_{i}") for i in range(1, upto + 1)])


def middle_pick(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row at place ⌊n/2⌋ of every key, whatever its size; null keys are one key. ``order`` begins with a number, date or time."""
    return row_at(df, [key], order, F.floor(F.col("__n") / 2))


def outside_windows(tags: DataFrame, date: str, tag: str, windows: DataFrame) -> DataFrame:
    """Tagged dates that lie in no window ``(tag, start, end)``, both ends inside, of their tag; tags without windows are not judged."""
    w = windows.select(F.col("tag").alias("__t"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    judged = tags.join(w.select("__t").distinct(), F.col(tag) == F.col("__t"), "left_semi")
    return judged.join(w, (F.col(tag) == F.col("__t")) & F.col(date).between(F.col("__s"), F.col("__e")), "left_anti")


def stray_fast_days(tags: DataFrame, date: str, tag: str, bounds: DataFrame) -> DataFrame:
    """Fast days that are no Friday and no weekday between Ash Wednesday and Easter of ``bounds (key, start)``."""
    at = bounds.where("key IN ('ash_wednesday', 'easter')").agg(F.max(F.when(F.col("key") == "ash_wednesday", F.col("start"))).alias("__a"), F.max(F.when(F.col("key") == "easter", F.col("start"))).alias("__e"))
    lent = F.coalesce((F.col(date) >= F.col("__a")) & (F.col(date) < F.col("__e")) & (F.dayofweek(date) != 1), F.lit(False))
    fast = tags.where(F.col(tag) == "fast_day")
    return fast.join(F.broadcast(at), F.lit(True)).where((F.dayofweek(date) != 6) & ~lent).drop("__a", "__e")


def untagged_markers(days: DataFrame, name: str, tag: str, words: list[str]) -> DataFrame:
    """Days whose name holds one of ``words`` and which have no tag, each word a row."""
    held = F.array_compact(F.array(*[F.when(F.lower(name).contains(w), F.lit(w)) for w in words]))
    return days.where(F.col(tag).isNull()).withColumn("marker", F.explode(held))


def lonely_eves(days: DataFrame, date: str, eve: str, kept: str) -> DataFrame:
    """Days with an eve whose following date (not row) is there yet neither ranked nor observed, or is not there: ``date``."""
    after = days.groupBy(F.date_sub(date, 1).alias("__d")).agg(F.bool_or(F.coalesce(F.col(kept), F.lit(False))).alias("__k"))
    eves = days.where(F.col(eve))
    return eves.join(after, F.col(date) == F.col("__d"), "left").where(~F.coalesce("__k", F.lit(False))).drop("__d", "__k")


def detected_bounds(days: DataFrame, date: str, name: str, phrases: DataFrame, twice: tuple[str, ...] = ("advent", "christmas")) -> DataFrame:
    """``key, start``: the first date whose name matches a phrase of ``phrases (key, phrase)``, exactly before in part. Keys of ``twice`` take two dates,
    as ``key_i`` and ``key_ii`` (``christmas`` itself for its first), and a row that matches one of them serves no other key."""
    p = phrases.select(F.col("key").alias("__k"), F.lower("phrase").alias("__p"))
    low = F.lower(F.trim(F.col(name)))
    rows = days.select(F.col(date).alias("__d"), low.alias("__n")).where("__n IS NOT NULL").distinct()
    hits = rows.join(F.broadcast(p), F.contains(F.col("__n"), F.col("__p"))).withColumn("__exact", F.col("__n") == F.col("__p"))
    double = hits.where(F.col("__k").isin(*twice))
    rest = hits.where(~F.col("__k").isin(*twice)).join(double.select("__d", "__n").distinct(), ["__d", "__n"], "left_anti")
    ranked = double.select("__k", "__d").distinct().withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy("__d"))).where("__r <= 2")
    label = F.when((F.col("__k") == "christmas") & (F.col("__r") == 1), "christmas").otherwise(F.concat("__k", F.when(F.col("__r") == 1, "_i").otherwise("_ii")))
    one = rest.groupBy("__k").agg(F.coalesce(F.min(F.when(F.col("__exact"), F.col("__d"))), F.min("__d")).alias("start"))
    return ranked.select(label.alias("key"), F.col("__d").alias("start")).unionByName(one.select(F.col("__k").alias("key"), "start"))
