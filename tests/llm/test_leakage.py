import random
import re
import unicodedata

from ferial.llm.leakage import find_leaks, without_leaks
from ferial.llm.words import words


def plain_words(t):
    return re.findall(r"\w+", unicodedata.normalize("NFD", t).casefold().replace("́", ""))


def brute(docs, items, k):
    out = set()
    for i, t in items:
        w = (t or "").lower().split()
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, x in docs:
            v = (x or "").lower().split()
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def test_words_see_through_disguise():
    def names(t):
        return words([t])[0].tolist()

    a = names("Ένα café, the FIELD stone 12 вода над Straße")
    for same in ("ένα café the ﬁeld st​one １２ Вода;НАД strasse", "ΈΝΑ CAFÉ — the fiеld [stοne]\n12  вoда над STRASSE"):
        assert names(same) == a, same
    assert names("cafe") != names("café") and names("12") != names("¹²") and names("ab") != names("ba")
    assert names("ệ") == names("ệ") == names("ệ")
    n, begin = words(["", "a b", "?", "c"])
    assert begin.tolist() == [0, 0, 2, 2, 3] and len(n) == 3


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(pick(rng.randint(3, 20)))) for i in range(25)] + [(98, None), (99, ""), (97, "w1 w2 w3")]
    items.append((96, items[0][1] + " x " + items[1][1]))
    docs = []
    for d in range(120):
        w = pick(rng.randint(0, 30))
        if rng.random() < 0.5:
            v = rng.choice(items[:25])[1].split()
            a = rng.randint(0, len(v))
            w[3:3] = v[a : a + rng.randint(2, 14)]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " ".join(vocab * 40000) + " " + items[2][1])]
    x = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, words int")
    y = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    for k in (1, 5, 9):
        rows = find_leaks(x, "doc_id", "text", y, "item_id", "text", k).collect()
        assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
        assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items, k), k
    text, ask = dict(docs), dict(items)
    for r in rows:
        a, b = text[r.doc_id].split(), ask[r.item_id].split()
        assert a[r.doc_word : r.doc_word + r.words] == b[r.item_word : r.item_word + r.words]
        assert r.words >= 9
    assert without_leaks(x, "doc_id", find_leaks(x, "doc_id", "text", y, "item_id", "text", 5)).count() == len(docs) - len({d for d, _ in brute(docs, items, 5)})
    assert find_leaks(x.limit(0), "doc_id", "text", y, "item_id", "text").count() == 0
    assert find_leaks(x, "doc_id", "text", y.limit(0), "item_id", "text").count() == 0


def test_item_blocks(spark, monkeypatch):
    import ferial.llm.leakage as leakage

    monkeypatch.setattr(leakage, "ITEM_BLOCK_CHARS", 40)
    items = spark.createDataFrame([(i, f"a{i} b c d e{i} f") for i in range(20)], "item_id int, text string")
    docs = spark.createDataFrame([(i, f"x a{i} B, c d e{i} f y") for i in range(20)], "doc_id int, text string")
    rows = find_leaks(docs, "doc_id", "text", items, "item_id", "text", 5).collect()
    assert sorted((r.doc_id, r.item_id, r.words) for r in rows) == [(i, i, 6) for i in range(20)]
