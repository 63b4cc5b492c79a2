"""Each of the twenty rules passes on a good form and fires on its own corruption."""

import pytest

from ferial.plans import coherence
from ferial.plans.coherence import dynamic_findings, static_findings

GOOD = [
    ("opening_responses", "leader", "Open us."), ("opening_responses", "response", "And we answer."), ("phos_hilaron", "leader", "a\nb\nc"), ("canticle", "label", "Great and Wonderful II"),
    ("canticle", "leader", "a\nb"), ("canticle", "rubric", "Morning Prayer continues\nwith the Psalm."), ("litany", "leader", "Hear."), ("litany", "response", "Hear us."),
    ("intercessions", "leader", "For all"), ("intercessions", "rubric", "The Lord’s Prayer."), ("seasonal_collects", "leader", "One line."), ("dismissal", "leader", "Go in peace,\nthe light keeps you."), ("dismissal", "response", "Amen."),
    ("psalm_rubrics", "rubric", "At the end of\u00a0the Psalm one of the following may be said or sung."), ("opening_responses", "response", "A line and\nits end."), ("litany", "leader", " \n "),
]
DAY = {"form": "f", "office": "ep", "season": "Advent", "psalms": 2, "lessons": 1, "doxology": True, "lesson_response": True, "collects": 1, "canticle": "Great and Wonderful II", "week_items": 2}
SEGMENTS = "form string, section string, kind string, text string, group_no int, seq int, path string, seg_id int"
DAYS = "form string, office string, season string, psalms int, lessons int, doxology boolean, lesson_response boolean, collects int, canticle string, week_items int"


def fired(spark, segments=None, title="T", season="Advent", least=3, sanctioned=(), **day):
    rows = [("f", *r[:3], r[3] if len(r) > 3 else None, i, str(i), i) for i, r in enumerate(segments if segments is not None else GOOD)]
    s = spark.createDataFrame(rows, SEGMENTS)
    titles = spark.createDataFrame([("f", season, title)], "form string, season string, title string")
    d = spark.createDataFrame([tuple((DAY | day)[k.split()[0]] for k in DAYS.split(", "))], DAYS)
    ok = spark.createDataFrame(list(sanctioned), "form string, section string, line string")
    out = static_findings(s, titles, spark.createDataFrame([("f", least)], "form string, least int")).unionByName(dynamic_findings(s, d, ok))
    return {(r.rule, r.tier) for r in out.collect()}


def without(section):
    return [r for r in GOOD if r[0] != section]


def changed(section, kind, text):
    return [(s, k, text) if (s, k) == (section, kind) else (s, k, t) for s, k, t in GOOD]


BROKEN = {
    "dismissal-has-amen": {"segments": changed("dismissal", "response", "So be it.")},
    "no-stray-space-before-period": {"segments": [*GOOD, ("x", "leader", "word .")]},
    "non-empty-responses": {"segments": [*GOOD, ("x", "response", "\u00a0a \n")]},
    "opening-has-leader-and-response": {"segments": without("opening_responses")},
    "no-empty-segments": {"segments": [*GOOD, ("x", "leader", " N\n")]},
    "canticle-has-verse-content": {"segments": without("canticle")},
    "evening-has-light": {"segments": without("phos_hilaron")},
    "leader-response-alternation": {"segments": [*GOOD, ("litany", "rubric", "A hush."), ("litany", "response", "Once more.")][:-1] + [("litany", "response", "x y z"), ("litany", "response", "Once more.")]},
    "psalter-gloria-present": {"doxology": False},
    "reading-response-present": {"lesson_response": False},
    "collect-resolvable": {"collects": 0},
    "no-prose-line-breaks": {"segments": [*GOOD, ("x", "leader", "a\nb")]},
    "canticle-has-verse-breaks": {"segments": changed("canticle", "leader", "a b")},
    "phos-hilaron-line-count": {"least": 4},
    "collect-and-dismissal-no-orphan-breaks": {"segments": changed("dismissal", "leader", "Go in peace\nthe light keeps you.")},
    "seasonal-title-coherence": {"title": " \u00a0"},
    "no-orphan-rubrics": {"segments": [*GOOD, ("x", "rubric", "The Lord’s Prayer is omitted.")]},
    "intercessions-nonempty": {"segments": [*without("intercessions"), ("intercessions", "leader", "")]},
    "seasonal-canticle-coherence": {"canticle": "Song of Moses and Miriam"},
    "collect-week-in-range": {"week_items": 0},
}


def test_all_rules_are_broken_here():
    assert set(BROKEN) == set(coherence.TIERS) and len(BROKEN) == 20


def test_a_good_form_passes(spark):
    assert fired(spark) == set()


@pytest.mark.parametrize("rule", sorted(BROKEN))
def test_a_broken_form_fires_its_rule(spark, rule):
    got = fired(spark, **BROKEN[rule])
    assert (rule, coherence.TIERS[rule]) in got
    assert len(got) == 1, got


def test_exemptions(spark):
    # what is absent passes, ordinary time needs no title, sanctioned lines end as they do, groups reset, trailing breaks are no breaks
    assert fired(spark, [*without("intercessions"), ("x", "leader", "a b\n")]) == set()
    assert fired(spark, season="OrdinaryTime", title=None) == set()
    orphan = BROKEN["collect-and-dismissal-no-orphan-breaks"]["segments"]
    assert fired(spark, orphan, sanctioned=[("f", "dismissal", "Go in peace")]) == set()
    assert fired(spark, [*GOOD, ("litany", "response", "one", 1), ("litany", "response", "two", 2)]) == set()
    assert fired(spark, office="mp", segments=without("phos_hilaron")) == set()
    assert fired(spark, season="Advent", psalms=0, doxology=False, lessons=0, lesson_response=False, canticle=None, week_items=None) == set()
    empty = spark.createDataFrame([], SEGMENTS)
    assert static_findings(empty, spark.createDataFrame([], "form string, season string, title string"), spark.createDataFrame([], "form string, least int")).count() == 0
