"""Lines of a page from positioned spans, and their reflow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_kind(size: Column, flags: Column, color: Column, body_size: float = 11.0, rubric_color: int = 0xC00000) -> Column:
    """What a span is by its style; bit 16 of the flags is bold."""
    return (
        F.when(size < body_size - 2, "footer").when(color == rubric_color, "rubric").when(size > body_size + 2, "heading").when(flags.bitwiseAND(16) != 0, "response").otherwise("leader")
    )


def lines_of(spans: DataFrame, tolerance: float = 2.0, part: tuple[str, ...] = ("page",)) -> DataFrame:
    """``part, line, y, x, text``: spans whose baselines lie within ``tolerance`` of their line's first, left to right.

    The line's first baseline is carried on, so that a slope does not chain: a fold over each page, in pandas. ``part`` names
    what makes a page: its number, and the book where there are several.
    """
    types = dict(spans.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for s in pdf.sort_values(["y0", "x0"], kind="stable").itertuples():
            if not rows or s.y0 - rows[-1][0] > tolerance:
                rows.append([s.y0, []])
            rows[-1][1].append((s.x0, s.text or ""))
        return pd.DataFrame(
            [(*(pdf[c].iloc[0] for c in part), i, y, min(p)[0], " ".join(t for _, t in sorted(p)).strip()) for i, (y, p) in enumerate(rows)], columns=[*part, "line", "y", "x", "text"]
        )

    return spans.groupBy(*part).applyInPandas(fold, ", ".join(f"{c} {types[c]}" for c in part) + ", line int, y double, x double, text string")


def reflow(
    lines: DataFrame, part: list[str], order: list[str], prose: Column, lead: float = 15.0, short: float = 60.0, decides: float = 3.0, room: float = 70.0,
    join: tuple[str, ...] = (), keep: tuple[str, ...] = (),
) -> DataFrame:  # noqa: E501
    """``part, text, undecided``: the lines of every part ``(text, lead, gap, slack)`` put together, and how many breaks the geometry left open.

    A line's break goes by what stands below it, in this order: more ``lead`` than a line's is a paragraph; in prose only a line ``short`` of the
    margin breaks, all others join; else the sign of ``slack``, the room left once the next line's first word were set here, decides if it is at least ``decides`` from
    0 (below 0 the break was forced); a line at the end of a page (null slack) with ``room`` to spare breaks; then the lines named in ``join`` and ``keep``;
    the rest breaks and is counted.
    """
    slack, gap, text = F.col("slack"), F.coalesce(F.col("gap"), F.lit(0.0)), F.trim("text")
    open_ = F.lit(None).cast("string")
    sep = (
        F.when(F.coalesce(F.col("lead"), F.lit(0.0)) > lead, "\n\n").when(prose, F.when(F.coalesce(slack >= short, F.lit(False)), "\n").otherwise(" "))
        .when(F.abs(slack) >= decides, F.when(slack < 0, " ").otherwise("\n")).when(slack.isNull() & (gap >= room), "\n")
    )
    sep = sep.when(text.isin(*join), " ") if join else sep
    sep = sep.when(text.isin(*keep), "\n") if keep else sep
    last = F.lead("text").over(Window.partitionBy(*part).orderBy(*order)).isNull()
    out = lines.where(F.col("text").isNotNull()).withColumn("__s", sep.otherwise(open_)).withColumn("__last", last)
    piece = F.concat(F.regexp_replace(text, r"[ \t]+", " "), F.when(F.col("__last"), "").otherwise(F.coalesce("__s", F.lit("\n"))))
    items = F.array_sort(F.collect_list(F.struct(*order, piece.alias("__t"))))
    return out.groupBy(*part).agg(F.array_join(F.transform(items, lambda x: x["__t"]), "").alias("text"), F.count_if(F.col("__s").isNull() & ~F.col("__last")).alias("undecided"))


def page_bounds(starts: DataFrame, start: str, last: int) -> DataFrame:
    """``end``: the page before the next start, ``last`` for the last; starts are a short table."""
    return starts.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(F.lit(0)).orderBy(start)) - 1, F.lit(last)))


def text_margin(lines: DataFrame, page: str, x: str, q: float = 0.995) -> DataFrame:
    """The ``q`` quantile (nearest rank) of right ends by page parity."""
    from ferial.operators.audit import nearest_rank

    return nearest_rank(lines.withColumn("parity", F.col(page) % 2), ["parity"], x, q)


def space_advance(gaps: DataFrame, gap: str, most: float = 8.0, default: float = 2.6) -> DataFrame:
    """One row ``space``: the median of the gaps between 0 and ``most``, both left out; ``default`` without any."""
    return gaps.where((F.col(gap) > 0) & (F.col(gap) < most)).agg(F.coalesce(F.median(gap), F.lit(default)).alias("space"))
