import os
import random

import pytest

from ferial.llm.mixture import TOKENIZER, fit, mixture, plan, shares, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the tokenizer files")


def test_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        total = sum(n * k for n, k in counts.items())
        budget = rng.randint(0, total + 5)
        got = fit(budget, counts)
        assert all(0 <= got[n] <= counts[n] for n in counts)
        size = sum(n * k for n, k in got.items())
        assert size <= budget
        # exact wherever the proportional start can be completed: never worse than its own best completion
        start = {n: k * min(budget, total) // total for n, k in counts.items()}
        sums = {sum(n * k for n, k in start.items())}
        for n in counts:
            sums |= {s + n * j for s in sums for j in range(counts[n] - start[n] + 1)}
        assert size == max(s for s in sums if s <= budget)
    big = fit(10**12 + 12345, {n: 10**9 for n in range(1, 400)})
    assert sum(n * k for n, k in big.items()) == 10**12 + 12345


def test_plan_keeps_caps():
    h = {"a": {5: 10, 7: 3}, "b": {11: 100}, "c": {3: 2}}
    b = plan(h, {"a": (0.5, 3), "b": (0.4, 1), "c": (0.1, 50), "missing": (0.2, 1)})
    total = sum(x.goal for x in b.values())
    assert set(b) == {"a", "b", "c"} and b["a"].repeats <= 3
    for s, x in b.items():
        used = x.repeats * sum(n * k for n, k in h[s].items()) + sum(n * k for n, k in x.extra.items())
        assert used <= x.goal
        assert all(x.repeats + -(-k // h[s][n]) <= {"a": 3, "b": 1, "c": 50}[s] for n, k in x.extra.items())
    assert total <= 71 * 3 / 0.5 + 3
    assert plan({}, {"a": (1.0, 1)}) == {}


def test_mixture_and_report(spark):
    rng = random.Random(2)
    words = ["stone", "river", "lamp ", "ō", "木"]
    rows = [(i, rng.choice(["a", "a", "a", "b", None, "x"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), 1) for i in range(600)]
    rows += [rows[0], rows[0], (9001, "a", None, 1), (9002, "a", "", 1), (9003, "b", "one two " * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.2, 5), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    tokens = {r.id: r.tokens for r in token_counts(docs, "doc_id", "source", "text").collect()}
    out = mixture(docs, targets).collect()
    assert len({r.doc_id for r in out}) == len(out)
    assert all(1 <= r.copies <= {"a": 2, "b": 5}[r.source] and tokens[r.doc_id] == r.tokens for r in out)
    size = {s: sum(r.tokens * r.copies for r in out if r.source == s) for s in "ab"}
    assert abs(size["a"] / size["b"] - 3.5) < 0.01
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixture(docs, targets).collect()))
    two = [{(r.doc_id, r.copies) for r in mixture(docs, targets, total=900, seed=k).collect()} for k in (42, 7)]
    assert two[0] != two[1] and all(0 < len(x) < 300 for x in two)
    report = {r.source: r for r in shares(mixture(docs, targets, total=900), targets).collect()}
    assert report["none"].actual_share == 0 and abs(report["a"].actual_share - 7 / 9) < 0.02
    assert mixture(docs.limit(0), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0


def test_other_tokenizers(spark):
    folder = os.path.dirname(TOKENIZER)
    docs = spark.createDataFrame([(1, "a", "Thirty stones, <|endoftext|> 木"), (2, "a", "x" * 20000)], "doc_id int, source string, text string")
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"):
        n = {r.id: r.tokens for r in token_counts(docs, "doc_id", "source", "text", f"{folder}/{name}").collect()}
        assert 5 < n[1] < 30
