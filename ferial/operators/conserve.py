"""Conservation of lines between a printed source and what is shipped, in both directions, with the rule that accounts for each line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferial.functions.text import grams, nfc, squash, strip
from ferial.operators.hot import running_sum
from ferial.runtime import broadcast_below, null_safe_hash, written

UNACCOUNTED = "UNACCOUNTED"
_NEEDLES = 500_000  # lines sought that may be broadcast


def line_key(c: Column) -> Column:
    """What a reader calls the same line: composed, every run of blanks one."""
    return squash(nfc(c))


@dataclass(frozen=True)
class Chain:
    """What differs between books: a repair of blanks, how an option's line becomes its label, which lines only divide, which sections
    the calendar fills, and labels that the structure gives."""

    fix: Callable[[Column], Column] = lambda c: c
    label: Callable[[Column], Column] = lambda c: F.regexp_replace(F.regexp_replace(strip(c), r"\s*\([^)]*\)\s*$", ""), r"^(?:The |An )", "")
    separator: str = r"(?i)^(?:or|and)\.?$"
    structural: str = r"^(?:I{1,3}|IV|V)$"
    filled: tuple[str, ...] = ()


def found_in(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """``unit, n``: the needles ``(unit, n)`` that stand in a text of ``hay (unit, h)`` of the same unit; blanks are single in both.

    Candidates come from an equi join: a line of four or more words has two inner words as neighbours there, one of three its middle
    word, a shorter one its first three letters. Only units with needles are searched, and only for keys of the kinds they need.
    """
    words = lambda c: F.split(c, " ")
    # neighbours by two slices: an index into the words would split the text again for every pair
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), rest(w)), F.slice(w, F.lit(2), rest(w)), lambda a, b: F.concat(F.lit("b"), a, F.lit(" "), b))
    w = words(F.col("n"))
    inner = F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))
    longest = F.array_max(F.transform(pairs(inner), lambda p: F.struct(F.length(p), p.alias("p")))).getField("p")
    size = F.least(F.length("n"), F.lit(3))
    key = F.when(F.size(w) >= 4, longest).when(F.size(w) == 3, F.concat(F.lit("w"), F.element_at(w, 2))).otherwise(F.concat(F.lit("g"), size.cast("string"), F.substring("n", 1, 3)))
    # units meet by a hash that tells a null from every value; texts are named by a hash, so that keys travel without them
    unit = null_safe_hash(F.col("unit")).alias("u")
    wanted = written(needles.where("n <> ''").distinct().withColumn("k", key).select(unit, "unit", "n", "k"))
    kinds = wanted.groupBy("u").agg(
        F.bool_or(F.col("k").startswith("b")).alias("__b"), F.bool_or(F.col("k").startswith("w")).alias("__w"), *[F.bool_or(F.col("k").startswith(f"g{z}")).alias(f"__g{z}") for z in (1, 2, 3)]
    )
    texts = hay.where("h IS NOT NULL").select(unit, "h", F.xxhash64("h").alias("t"))
    x, none = words(F.col("h")), F.expr("cast(array() as array<string>)")
    cut = lambda z: F.transform(grams(F.col("h"), z), lambda g: F.concat(F.lit(f"g{z}"), g))
    keys = F.concat(
        F.when(F.col("__b") & (F.size(x) > 1), pairs(x)).otherwise(none), F.when(F.col("__w"), F.transform(x, lambda y: F.concat(F.lit("w"), y))).otherwise(none),
        *[F.when(F.col(f"__g{z}"), cut(z)).otherwise(none) for z in (1, 2, 3)],
    )
    laid = texts.join(kinds, "u").select("u", "t", F.explode(F.array_distinct(F.transform(keys, lambda y: F.xxhash64(y)))).alias("k"))
    # few needles go to the keys, so that the keys of all texts are not shuffled
    asked = broadcast_below(wanted, F.lit(1), _NEEDLES).withColumn("k", F.xxhash64("k"))
    near = laid.join(asked, ["u", "k"]).select("u", "t", "unit", "n").distinct()
    return near.join(texts, ["u", "t"]).where(F.contains(F.col("h"), F.col("n"))).select("unit", "n").distinct()


def _flag(df: DataFrame, hits: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: are its unit and ``on`` among ``hits (unit, n)``?"""
    h = hits.select(F.col("unit").alias("__u"), F.col("n").alias("__n")).distinct().withColumn("__x", F.lit(True))
    out = df.join(h, (F.col(on) == F.col("__n")) & F.col("unit").eqNullSafe(F.col("__u")), "left")
    return out.withColumn(name, F.coalesce("__x", F.lit(False))).drop("__u", "__n", "__x")


def _lines(shipped: DataFrame) -> DataFrame:
    return shipped.select("unit", "section", "type", F.explode(F.split("text", "\n")).alias("line")).withColumn("n", line_key(F.col("line"))).where("n <> ''")


def _blocks(shipped: DataFrame) -> DataFrame:
    return shipped.select("unit", line_key(F.replace("text", F.lit("\n"), F.lit(" "))).alias("h")).where("h <> ''").distinct()


def page_to_data(page: DataFrame, shipped: DataFrame, chain: Chain = Chain(), rebuilt: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``unit, section, seq, text, rule`` for every printed line ``page (unit, section, type, seq, text, used_as)``.

    The first rule that holds: verbatim (a shipped line), reflowed (inside a shipped block), whitespace (either, once repaired), heading, separator,
    label (an option named by a shipped label), lectionary (a section the calendar fills), corrected (``rebuilt (unit, before, after)``, the
    extracted blocks with the corrections applied, turned a block with it into shipped text), else UNACCOUNTED.
    ``shipped (unit, section, type, text)`` has a block a row. Blank and null lines are left out; repeated ones each count.
    """
    p = page.withColumn("n", line_key(F.col("text"))).where("n <> ''").withColumn("fixed", line_key(chain.fix(F.col("text")))).withColumn("named", line_key(chain.label(F.col("text"))))
    # keys need Python: they are made once
    p, lines, blocks = written(p), written(_lines(shipped)), written(_blocks(shipped))
    labels = lines.where("type = 'label'").select("unit", "n")
    asked = p.select("unit", "n", "fixed", "named").distinct()
    out = written(_flag(_flag(asked, lines, "n", "__verbatim"), lines, "fixed", "__fixed_line"))
    # each search is for what the rules before it leave
    open_ = out.where("NOT __verbatim")
    reflowed = written(found_in(blocks, open_.select("unit", "n")))
    open_ = written(_flag(open_, reflowed, "n", "__r").where("NOT __r AND NOT __fixed_line").select("unit", "n", "fixed"))
    out = _flag(out, reflowed, "n", "__reflowed")
    out = _flag(out, found_in(blocks, open_.select("unit", F.col("fixed").alias("n"))), "fixed", "__fixed_part")
    out = _flag(out, labels, "named", "__label")
    if rebuilt is None:
        out = out.withColumn("__corrected", F.lit(False))
    else:
        changed = rebuilt.where("before <> after")
        fitting = _flag(changed, found_in(blocks, changed.select("unit", F.col("after").alias("n"))), "after", "__fits").where("__fits")
        out = _flag(out, found_in(fitting.select("unit", F.col("before").alias("h")), open_.select("unit", "n")), "n", "__corrected")
    marks = out.select(F.col("unit").alias("__u"), F.col("n").alias("__n"), F.col("fixed").alias("__f"), F.col("named").alias("__l"), *[c for c in out.columns if c.startswith("__")])
    same = F.col("unit").eqNullSafe(F.col("__u")) & (F.col("n") == F.col("__n")) & (F.col("fixed") == F.col("__f")) & (F.col("named") == F.col("__l"))
    filled = F.col("section").isin(*chain.filled) if chain.filled else F.lit(False)
    rule = (
        F.when(F.col("__verbatim"), "verbatim").when(F.col("__reflowed"), "reflowed").when(F.col("__fixed_line") | F.col("__fixed_part"), "whitespace")
        .when(F.col("used_as") == "heading", "heading").when(F.col("n").rlike(chain.separator), "separator").when(F.col("__label"), "label")
        .when(filled & ~F.coalesce(F.col("used_as").isin("label", "rubric"), F.lit(False)), "lectionary").when(F.col("__corrected"), "corrected").otherwise(UNACCOUNTED)
    )
    return p.join(marks, same).select("unit", "section", "seq", "text", rule.alias("rule"))


def page_stream(page: DataFrame, order: list[str], longest: int) -> DataFrame:
    """``unit, h``: a unit's printed lines joined by a blank, in pieces that overlap so that any run of up to ``longest`` characters
    lies in one. No unit is gathered whole."""
    return _pieces(page.select("unit", *order, line_key(F.col("text")).alias("n")).where("n <> ''"), order, longest)


def _pieces(p: DataFrame, order: list[str], longest: int) -> DataFrame:
    reach = max(longest, 2_000)
    placed = running_sum(p, ["unit"], order, F.length("n") + 1, "__end").withColumn("__c", F.floor((F.col("__end") - F.length("n") - 1) / reach))
    both = placed.select("unit", *order, "n", F.explode(F.array(F.col("__c"), F.col("__c") - 1)).alias("__c"))
    items = F.array_sort(F.collect_list(F.struct(*order, "n")))
    return both.groupBy("unit", "__c").agg(F.array_join(F.transform(items, lambda x: x["n"]), " ").alias("h")).select("unit", "h")


def data_to_page(page: DataFrame, shipped: DataFrame, order: list[str], chain: Chain = Chain(), rebuilt: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """``unit, section, type, line, rule`` for every distinct shipped line of a unit.

    The first rule that holds: printed (a printed line), printed-joined (inside the page read as one text in ``order``), whitespace (the same, once
    repaired), label (what the label of a printed option is), structural (a label the structure gives), corrected (the corrections brought it: a rebuilt
    block holds it after them and not before), else UNACCOUNTED. A line of several blocks has the least of their sections.
    """
    # keys need Python: they are made once
    lines = written(_lines(shipped).groupBy("unit", "n").agg(F.min(F.struct("section", "type")).alias("o")).select("unit", "n", "o.*"))
    p = written(page.select("unit", *order, "text", line_key(F.col("text")).alias("n"), line_key(chain.label(F.col("text"))).alias("named")).where("n <> ''"))
    out = written(_flag(lines, p.select("unit", "n"), "n", "__printed"))
    longest = lines.agg(F.max(F.length("n"))).first()[0] or 1
    stream = written(_pieces(p, order, longest))
    # each search is for what the rules before it leave
    open_ = out.where("NOT __printed").select("unit", "n")
    joined = written(found_in(stream, open_))
    open_ = written(open_.subtract(joined))
    fixed = written(found_in(stream.select("unit", line_key(chain.fix(F.col("h"))).alias("h")), open_))
    open_ = open_.subtract(fixed)
    out = _flag(_flag(out, joined, "n", "__joined"), fixed, "n", "__fixed")
    out = _flag(out, p.select("unit", F.col("named").alias("n")), "n", "__label")
    if rebuilt is None:
        out = out.withColumn("__corrected", F.lit(False))
    else:
        # a line is new in a block if the block after the corrections holds it and the block before does not
        near = found_in(rebuilt.select("unit", F.col("after").alias("h")), open_)
        pairs = near.join(rebuilt.select(F.col("unit").alias("__u"), "before", "after"), F.col("unit").eqNullSafe(F.col("__u"))).where(F.contains("after", F.col("n")) & ~F.contains("before", F.col("n")))
        out = _flag(out, pairs.select("unit", "n"), "n", "__corrected")
    label = F.col("type") == "label"
    rule = (
        F.when(F.col("__printed"), "printed").when(F.col("__joined"), "printed-joined").when(F.col("__fixed"), "whitespace").when(label & F.col("__label"), "label")
        .when(label & F.col("n").rlike(chain.structural), "structural").when(F.col("__corrected"), "corrected").otherwise(UNACCOUNTED)
    )
    return out.select("unit", "section", "type", F.col("n").alias("line"), rule.alias("rule"))


def accounts(page_rules: DataFrame, data_rules: DataFrame) -> DataFrame:
    """``direction, rule, unit, lines``: how many lines each rule accounts for, by unit and (null unit and ``whole``) in all."""
    both = page_rules.select(F.lit("page").alias("direction"), "rule", "unit").unionByName(data_rules.select(F.lit("data").alias("direction"), "rule", "unit"))
    sums = both.groupBy("direction", "rule", "unit").agg(F.count("*").alias("lines"))
    total = sums.groupBy("direction", "rule").agg(F.sum("lines").alias("lines")).select("direction", "rule", F.lit(None).cast("string").alias("unit"), F.lit(True).alias("whole"), "lines")
    return sums.select("direction", "rule", F.col("unit").cast("string").alias("unit"), F.lit(False).alias("whole"), "lines").unionByName(total)
