"""The coherence rules of an office form: what its segments, its title and a bound day must agree on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferial.functions.text import strip
from ferial.operators.audit import Rule, run_rules
from ferial.operators.segments import alternation_breaks
from ferial.runtime import small

# fixed values: sections in which a line break is meant, parts of the proclamation, sections that must alternate
VERSE_SECTIONS = (
    "opening_responses", "responsory", "canticle", "invitatory", "phos_hilaron", "thanksgiving_for_light", "lords_prayer_intro",
    "intercessions", "affirmation", "litany", "dismissal",
)
PROCLAMATION = ("psalm_rubrics", "reading_rubrics", "responsory", "canticle", "affirmation")
DIALOGUES = ("responsory", "litany", "dismissal")
LIGHT = ("phos_hilaron", "thanksgiving_for_light")
# fixed values: canticles that may open the alternatives of a season, by the beginning of their label
DAILY_CANTICLES = ("Song of Zechariah", "Song of Mary")
SEASONAL_CANTICLES = {
    "Advent": ("A Song of Christ’s Glory", "A Song of Christ the Servant", "Great and Wonderful", "A Song of Baruch"),
    "Christmas": ("Song of Christ’s Glory", "Great and Wonderful"),
    "Epiphany": ("Song of Christ’s Glory", "A Song of Christ the Servant", "Great and Wonderful"),
    "Lent": ("Song of Moses and Miriam", "Song of Christ’s Appearing", "Song of Manasseh", "Prayer of Habakkuk", "A Song of Christ the Servant", "Song of David"),
    "Passiontide": ("Song of Moses and Miriam", "A Song of Christ the Servant", "Song of Christ’s Appearing", "Song of Manasseh"),
    "Easter": ("Bless the Lord", "Song of Christ’s Glory", "Song of Moses and Miriam", "Great and Wonderful", "Song of Deliverance"),
    "Pentecost": ("Bless the Lord", "Song of Deliverance", "A Song of God’s Grace", "A Song of Faith", "Song of Christ’s Glory"),
}
# fixed values: rubrics that may close a section
CLOSING_RUBRICS = (
    r"^The Lord['’]?s Prayer\.?\s*$",
    r"^The community may offer its intercessions, petitions, and thanksgivings",
    r"^(?:Morning|Evening)\s+Prayer\s+continues\s+with\s[\s\S]+\.$",
    r"^At the end of the Psalm(?:\(s\))? one of the following may be said or sung\.$",
    r"^After the Psalm one of the following may be said or sung\.$",
    r"^If two Readings are read, then the Responsory follows the first Reading and the Canticle the second\.$",
)
TIERS = {
    "dismissal-has-amen": 1, "no-stray-space-before-period": 1, "non-empty-responses": 1, "opening-has-leader-and-response": 1, "no-empty-segments": 1,
    "canticle-has-verse-content": 1, "evening-has-light": 1, "leader-response-alternation": 1, "psalter-gloria-present": 1, "reading-response-present": 1,
    "collect-resolvable": 1, "no-prose-line-breaks": 2, "canticle-has-verse-breaks": 2, "phos-hilaron-line-count": 2,
    "collect-and-dismissal-no-orphan-breaks": 2, "seasonal-title-coherence": 2, "no-orphan-rubrics": 2, "intercessions-nonempty": 2,
    "seasonal-canticle-coherence": 3, "collect-week-in-range": 3,
}
#: rules that need a bound day; the others read the form alone
DYNAMIC = frozenset({
    "evening-has-light", "psalter-gloria-present", "reading-response-present", "collect-resolvable", "collect-week-in-range", "seasonal-canticle-coherence",
    "canticle-has-verse-breaks", "canticle-has-verse-content", "collect-and-dismissal-no-orphan-breaks", "intercessions-nonempty",
})


@dataclass(frozen=True)
class Sections:
    """Names of the sections the rules look at; other books name them otherwise."""

    dismissal: str = "dismissal"
    opening: str = "opening_responses"
    canticle: str = "canticle"
    intercessions: str = "intercessions"
    hymn: str = "phos_hilaron"
    collects: str = "seasonal_collects"
    verse: tuple[str, ...] = VERSE_SECTIONS
    proclamation: tuple[str, ...] = PROCLAMATION
    dialogues: tuple[str, ...] = DIALOGUES
    light: tuple[str, ...] = LIGHT
    order: tuple[str, ...] = field(default=("seq", "path", "seg_id"))


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def aggregate_rules(s: Sections) -> list[Rule]:
    """The rules that one aggregation over the segments of a form decides; texts count as shown, without blanks at their ends."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    kind, section = F.col("kind"), F.col("section")
    shown = text != ""
    spoken = kind.isin("leader", "response") & shown
    at = lambda name, test=shown: _any((section == name) & test)
    broken = {
        "dismissal-has-amen": at(s.dismissal) & ~at(s.dismissal, text.contains("Amen")),
        "no-stray-space-before-period": _any(text.rlike(r"Amen \.|\w \.$")),
        "non-empty-responses": _any((kind == "response") & (F.length(text) < 3)),
        "opening-has-leader-and-response": ~(at(s.opening, (kind == "leader") & shown) & at(s.opening, (kind == "response") & shown)),
        "no-empty-segments": _any(text == "N"),
        "no-prose-line-breaks": _any(spoken & ~section.isin(*s.verse) & text.contains("\n")),
        "canticle-has-verse-content": _any(section.isin(*s.proclamation) & shown) & ~at(s.canticle, (kind == "leader") & shown),
        "canticle-has-verse-breaks": at(s.canticle) & ~at(s.canticle, (kind == "leader") & text.contains("\n")),
        "intercessions-nonempty": _any(section == s.intercessions) & ~at(s.intercessions, (F.length(text) > 2) & (text != "N")),
    }
    return [Rule(name, TIERS[name], test) for name, test in broken.items()]


def _fired(units: DataFrame, rule: str) -> DataFrame:
    return units.select("form", F.lit(rule).alias("rule"), F.lit(TIERS[rule]).alias("tier")).distinct()


def static_findings(segments: DataFrame, titles: DataFrame, hymn_lines: DataFrame, s: Sections = Sections()) -> DataFrame:  # noqa: B008
    """``form, rule, tier`` of the rules that need no day.

    ``segments (form, section, kind, text, group_no, order…)``; ``titles (form, season, title)`` holds every form; ``hymn_lines (form,
    least)`` the fewest lines the hymn of light may have.
    """
    rules = [r for r in aggregate_rules(s) if r.name not in DYNAMIC]
    out = run_rules(segments, "form", rules)
    # neighbours of one kind, unless a group opens or closes between them
    spoken = segments.where(F.col("section").isin(*s.dialogues))
    out = out.unionByName(_fired(alternation_breaks(spoken, ["form", "section"], list(s.order), "group_no"), "leader-response-alternation"))
    first = F.min_by("text", F.struct(*s.order))
    hymns = segments.where((F.col("section") == s.hymn) & (F.col("kind") == "leader")).groupBy("form").agg(first.alias("text"))
    short = hymns.join(hymn_lines, "form").where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) < F.col("least"))
    out = out.unionByName(_fired(short, "phos-hilaron-line-count"))
    untitled = titles.where((F.col("season") != "OrdinaryTime") & (strip(F.coalesce("title", F.lit(""))) == ""))
    out = out.unionByName(_fired(untitled, "seasonal-title-coherence"))
    shown = segments.where(strip(F.coalesce("text", F.lit(""))) != "")
    last = shown.groupBy("form", "section").agg(F.max_by(F.struct("kind", strip(F.col("text")).alias("text")), F.struct(*s.order)).alias("l"))
    # a book binds words by non-breaking spaces; they count as plain ones
    text = F.translate("l.text", " ", " ")
    closing = F.lit(False)
    for p in CLOSING_RUBRICS:
        closing = closing | text.rlike(p if p.startswith("^(?:M") else "(?i)" + p if "Prayer" in p else p)
    return out.unionByName(_fired(last.where((F.col("l.kind") == "rubric") & ~closing), "no-orphan-rubrics"))


def dynamic_findings(segments: DataFrame, days: DataFrame, sanctioned: DataFrame, s: Sections = Sections()) -> DataFrame:  # noqa: B008
    """``form, rule, tier`` of the rules over bound days ``days (form, office, season, psalms, lessons, doxology, lesson_response,
    collects, canticle, week_items)``: one row a form with counts of what the day appoints, whether the doxology and the response to the lesson
    stand there, how many collects can be had, the label of the first canticle, and how many seasonal items its week has (null where
    the form has none). ``sanctioned (form, section, line)`` are lines that may end without punctuation.
    """
    bound = segments.join(days.select("form").distinct(), "form", "left_semi")
    rules = [r for r in aggregate_rules(s) if r.name in DYNAMIC]
    out = run_rules(bound, "form", rules)
    lit = bound.where(F.col("section").isin(*s.light) & (strip(F.coalesce("text", F.lit(""))) != "")).select("form").distinct()
    out = out.unionByName(_fired(days.where("office = 'ep'").join(lit, "form", "left_anti"), "evening-has-light"))
    out = out.unionByName(_fired(days.where("psalms > 0 AND NOT doxology"), "psalter-gloria-present"))
    out = out.unionByName(_fired(days.where("lessons > 0 AND NOT lesson_response"), "reading-response-present"))
    out = out.unionByName(_fired(days.where("collects = 0"), "collect-resolvable"))
    out = out.unionByName(_fired(days.where("season <> 'OrdinaryTime' AND week_items = 0"), "collect-week-in-range"))
    allowed = small(days.sparkSession, [(k, list(DAILY_CANTICLES + v)) for k, v in SEASONAL_CANTICLES.items()], "season string, allowed array<string>")
    odd = days.where("canticle IS NOT NULL").join(allowed, "season").where(~F.exists("allowed", lambda a: F.col("canticle").startswith(a)))
    out = out.unionByName(_fired(odd, "seasonal-canticle-coherence"))
    lines = bound.where(F.col("section").isin(s.collects, s.dismissal) & F.col("kind").isin("leader", "response"))
    parts = F.split(strip(F.col("text")), "\n")
    lines = lines.select("form", "section", F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("line")).withColumn("line", strip(F.col("line")))
    open_ = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"[.,;:!?]\s*$")).join(sanctioned, ["form", "section", "line"], "left_anti")
    return out.unionByName(_fired(open_, "collect-and-dismissal-no-orphan-breaks"))
