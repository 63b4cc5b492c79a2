import random
import unicodedata
from itertools import combinations

from ferial.llm import lookalike
from ferial.llm.fold import look, natural
from ferial.llm.lookalike import VocabularyTrie, by_table, lookalike_classes, lookalike_pairs, normalise, spelled

SAME = [
    ("ashﬆead", "ashstead"), ("Ｌ̌ｕｂｒａｎ", "Ľubran"), ("K", "K"), ("Å", "Å"), ("hοney", "honey"), ("ԁuѕk", "dusk"), ("a‐b", "a-b"),
    ("\u212a", "K"), ("\u212b", "A\u030a"), ("e\u0323\u0302", "\u1ec7"), ("e\u0302\u0323", "\u1ec7"), ("a\u3000b", "a b"), ("sea\u200bling", "sea\u00adling"),
    ("a　b", "a b"), ("a b", "a b"), ("sea​ling", "sealing"), ("co͏rn", "corn"), ("тишинa", "тишина"), ("Kαμπάνα", "Καμπάνα"), ("２．", "2."),
    ("ﬁﬀﬄ", "fiffffl"), ("Việtor", "Việtor"), ("\r\n", "\n"), ("goӏd", "gold"),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("2", "²"), ("a  b", "a b"), ("a b", "a\nb"), ("—", "-"), ("l", "1"), ("O", "0"), ("’", "'"), ("½", "1/2")]


def test_look():
    for a, b in SAME:
        assert look(a) == look(b), (a, b)
    for a, b in DIFFERENT:
        assert look(a) != look(b), (a, b)
    assert natural("тишина") and natural("naïve") and not natural("тишинa") and not natural("ﬁeld") and not natural("e\u0301")


def test_trie_prefers_latin_then_frequent():
    t = VocabularyTrie([("вода", 9), ("сор", 5), ("cop", 1), ("соре", 7)])
    assert t.canonical("вοда") == "вода"
    assert t.canonical("сор") == t.canonical("ｃор") == "cop"
    assert t.canonical("сοpe") == "соре"
    assert t.canonical("zｚ​") is None and by_table("zｚ​") == "zz" and by_table("​") == ""


def test_automaton_weights():
    t = VocabularyTrie([("sealing", 5), ("ceiling", 2), ("σεал", 1), ("seal", 9), ("côte", 1), ("ﬁ", 1)])
    assert t.near("ѕеа\u200bling") == [(0, "sealing", 5)] == t.near("ｓeaＬing".replace("Ｌ", "ｌ"))
    assert t.near("sealin") == [] and t.near("Sealing") == []
    assert t.near("sеalin", 1) == t.near("sealiиng", 1) == t.near("zealing", 1) == [(1, "sealing", 5)]
    assert t.near("sealing", 3) == [(0, "sealing", 5), (2, "ceiling", 2), (3, "seal", 9)]
    assert t.near("co\u0302te") == [(0, "côte", 1)] and t.near("cote") == [] and t.near("cote", 1) == [(1, "côte", 1)]
    assert t.near("", 0) == [] and VocabularyTrie([]).near("a", 2) == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (look(x) != look(y))))
    return row[-1]


def test_automaton_against_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("аaоoрpxу") for _ in range(rng.randint(1, 6)))
    words = sorted({word() for _ in range(80)})
    t = VocabularyTrie([(w, 1) for w in words])
    for budget in (0, 1, 2):
        for token in [word() for _ in range(40)]:
            want = sorted((d, w, 1) for w in words if (d := levenshtein(token, w)) <= budget)
            assert t.near(token, budget) == want, (token, budget)


def test_spellings_come_from_the_trie_and_the_table_takes_the_rest(monkeypatch):
    tokens = ["море", "мoре", "zｚ​"]
    with_words, without = VocabularyTrie([("море", 2)]), VocabularyTrie([])
    assert spelled(tokens, with_words) == ["море", "море", "zz"]
    # a table alone spells no word of another script as it is written
    by_look = spelled(tokens, without)
    assert by_look[0] == by_look[1] != "море"
    monkeypatch.setattr(lookalike, "by_table", lambda token: token)
    assert spelled(tokens, with_words) == ["море", "море", "zｚ​"]
    assert spelled(tokens, without) == tokens


def disguise(rng, t):
    out = []
    for c in t:
        k = rng.random()
        out.append({"o": "ο", "a": "а", "e": "е", " ": " "}.get(c, c) if k < 0.2 else chr(ord(c) + 0xFEE0) if k < 0.3 and "!" <= c <= "~" else c + "​" if k < 0.35 else c)
    return "".join(out)


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "_HOT_ROWS", 5)
    rng = random.Random(4)
    base = ["one lamp", "One lamp", "café au lait", "cafe au lait", "море и небо", "Νησί", "I", "tab\there", "a" * 3000, "木 石", "x²", "x2"]
    rows = []
    for i in range(300):
        t = rng.choice(base[:1] * 4 + base)
        rows.append((i, rng.choice([t, t, disguise(rng, t), unicodedata.normalize("NFD", t), unicodedata.normalize("NFKC", t) if "²" not in t else t])))
    rows += [(900, None), (901, ""), (902, "​"), (903, "‍"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "id bigint, text string, n int, token string")
    got = [tuple(r) for r in lookalike_pairs(df, "id", "text").collect()]
    want = {(a[0], b[0]) for a, b in combinations(sorted({r for r in rows if r[1]}), 2) if a[1] != b[1] and look(a[1]) == look(b[1])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert lookalike_pairs(df.limit(0), "id", "text").count() == 0
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    least = {}
    for a, b in sorted(want):
        least[b] = min(least.get(b, b), least.get(a, a))
    rows_of = {r.id: (r.class_id, r.links) for r in lookalike_classes(df, "id", "text").collect()}
    assert {i: n for i, (_, n) in rows_of.items()} == links
    assert all(rows_of[a][0] == rows_of[b][0] <= a for a, b in want) and all(c == min(i for i, (k, _) in rows_of.items() if k == c) for c, _ in rows_of.values())
    assert lookalike_classes(df.limit(0), "id", "text").count() == 0


def test_normalise(spark):
    df = spark.createDataFrame([(1, "море, мoре"), (2, "море, море"), (3, None), (4, ""), (5, "hοney ﬁeld"), (6, "honey field")], "id int, text string")
    out = {r.id: r.canonical for r in normalise(df, "text").collect()}
    assert out[1] == out[2] == "море, море" and out[3] is None and out[4] == "" and out[5] == out[6] == "honey field"
