import random
from collections import defaultdict

import numpy as np

from ferial.llm import spans
from ferial.llm.spans import _chars, shared_chars


def brute(rows, k):
    by = defaultdict(set)
    texts = {i: t for i, t in rows if t}
    for i, t in texts.items():
        for p in range(len(t) - k + 1):
            by[t[p : p + k]].add(i)
    out = {}
    for i, t in texts.items():
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - k + 1):
            if len(by[t[p : p + k]]) > 1:
                hit[p : p + k] = True
        if hit.any():
            out[i] = int(hit.sum())
    return out


def corpus(seed, n, alphabet):
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice(alphabet) for _ in range(m))
    pool = [word(rng.randint(60, 140)) for _ in range(12)]
    rows = []
    for i in range(n):
        t = word(rng.randint(0, 60)) + rng.choice(pool)[rng.randint(0, 30) :] + word(rng.randint(0, 40))
        if rng.random() < 0.3:
            t += rng.choice(pool) + word(rng.randint(0, 9))
        rows.append((i, t))
    return rows


def block(two):
    chars, offsets = _chars(two)
    doc_start = np.zeros(len(chars) + 1, bool)
    doc_start[offsets] = True
    return chars, offsets, doc_start[:-1]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "t bigint, text string").repartition(3)


def rounds(spark, texts, n):
    tables = []
    for _ in range(n):
        tables.append(spans.name_pairs(frame(spark, texts), tables))
    return tables


def test_every_shared_substring_keeps_a_common_high_level_symbol(spark):
    for seed, alphabet in enumerate(["ab", "abcdefgh ", "a", "aab", "xyzäöü\n"]):
        rng = random.Random(seed)
        word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        for size in (80, 8, 21, 150, 300, 5):
            n, spell = spans._layout(size)
            cores = [word(size) for _ in range(60)]
            tables = rounds(spark, [word(300) for _ in range(5)] + cores, n)
            for core in cores:
                a, b = word(rng.randint(0, 70)), word(rng.randint(0, 70))
                chars, offsets, doc_start = block([a + core + b, b + core + a[::-1]])
                name, start, stop = spans.high_symbols(chars, offsets, doc_start, tables, spell)
                inside = [
                    {(int(x), int(s - offsets[k] - at)) for x, s, e in zip(name, start, stop) if offsets[k] + at <= s and e <= offsets[k] + at + size}
                    for k, at in ((0, len(a)), (1, len(b)))
                ]
                assert inside[0] & inside[1], (size, alphabet)


def test_rounds_name_globally_and_decide_the_symbols(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(50)]
    n, spell = spans._layout(80)
    tables = rounds(spark, texts, n)
    chars, offsets, doc_start = block(texts)
    levels = spans.parse(chars, doc_start, tables)
    # every round joins: symbols become fewer, none is longer than its bound, and a name always spells the same
    assert all(len(b[0]) < 0.85 * len(a[0]) for a, b in zip(levels, levels[1:]))
    spelled = {}
    for r, (start, symbol) in enumerate(levels):
        stop = np.append(start[1:], len(chars))
        assert (stop - start).max() <= 2**r and doc_start[0] and set(offsets[:-1]) <= set(start)
        for a, b, s in zip(start, stop, symbol):
            assert spelled.setdefault(int(s), chars[a:b].tobytes()) == chars[a:b].tobytes()
    with_rounds = len(spans.high_symbols(chars, offsets, doc_start, tables, spell)[0])
    # without the rounds every character begins a symbol
    without = len(spans.high_symbols(chars, offsets, doc_start, [spans.Names(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n, spell)[0])
    assert with_rounds < 0.3 * without
    # names counted over other texts cut otherwise
    other = rounds(spark, [t[::-1] for t in texts], n)
    assert not np.array_equal(levels[-1][0], spans.parse(chars, doc_start, other)[-1][0])


def test_maximum_cut():
    left = spans.maximum_cut([(1, 2, 10), (2, 3, 9), (3, 3, 50), (4, 2, 5)])
    assert 1 in left and 2 not in left and 4 in left


def test_any_least_length(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))) for i in range(60)] + [(99, "q")]
    df = spark.createDataFrame(rows, "id int, text string")
    for k in (1, 5, 12, 41):
        assert {r.id: r.shared_chars for r in shared_chars(df, "id", "text", k).collect()} == brute(rows, k), k


def test_wide_joins(spark, monkeypatch):
    """Beyond the bounds of a broadcast the same rows come out."""
    rows = corpus(3, 60, "abcdefgh ")
    df = spark.createDataFrame(rows, "id bigint, text string")
    monkeypatch.setattr(spans, "_LIVE", 0)
    monkeypatch.setattr(spans, "_MARKS", 0)
    assert {r.id: r.shared_chars for r in shared_chars(df, "id", "text").collect()} == brute(rows, 80)


def test_against_brute_force(spark):
    for seed, alphabet in enumerate(["abcdefgh ", "ab", "é漢字ab\n"]):
        rows = corpus(seed, 120, alphabet)
        rows += [(1000, "x" * 300), (1001, "x" * 79), (1002, None), (1003, ""), (1004, rows[3][1]), rows[3], rows[3], (1005, "ab" * 90), (1006, "ba" * 60), (1007, "y" * 200)]
        df = spark.createDataFrame([(*r, 0, "n") for r in rows], "seg_id bigint, text string, pos int, name string")
        got = {r.seg_id: r.shared_chars for r in shared_chars(df, "seg_id", "text").collect()}
        assert got == brute(dict(rows).items(), 80)


def test_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghij ") for _ in range(2_500_000))
    df = spark.createDataFrame([(1, long), (2, "q" * 10 + long[1_234_567:1_236_567] + "q"), (3, "z" * 90)], "seg_id bigint, text string")
    got = {r.seg_id: r.shared_chars for r in shared_chars(df, "seg_id", "text").collect()}
    assert got == {1: 2000, 2: 2000}
    assert shared_chars(df.limit(0), "seg_id", "text").count() == 0
