import random
from datetime import datetime

from pyspark.sql import functions as F

from ferial.operators import reconcile
from ferial.operators.reconcile import checksum_tree, diff_copies, differing_leaves

SCHEMA = "form string, seq int, type string, text string, loaded_at timestamp, __side string, diff int"


def brute(a, b):
    def held(rows):
        best = {}
        for r in rows:
            k = r[:2]
            if k not in best or r[4] > best[k][4]:
                best[k] = r
        return best

    a, b = held(a), held(b)
    out = [(*k, "only_left") for k in a if k not in b] + [(*k, "only_right") for k in b if k not in a]
    for k in a:
        if k in b:
            out += [(*k, f) for f, i in (("type", 2), ("text", 3)) if a[k][i] != b[k][i]]
    return sorted(map(str, out))


def run(spark, a, b, **kw):
    x, y = (spark.createDataFrame(r, SCHEMA) for r in (a, b))
    return sorted(str(tuple(r)) for r in diff_copies(x, y, ["form", "seq"], ["type", "text"], "loaded_at", **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    t = lambda n: datetime(2030, 1, 1, 0, n // 60 % 60, n % 60)

    def side(seed):
        r, rows = random.Random(seed), []
        for i in range(600):
            f = r.choice(["hot"] * 3 + [f"f{i % 40}", None])
            rows.append((f, r.choice([i % 90, None]), r.choice(["a", "b", None]), r.choice(["", "x", "é", None]), t(len(rows)), "s", 1))
        return rows

    a, b = side(1), side(2)
    b += [(*r[:4], t(2000 + i), "s", 1) for i, r in enumerate(a[:500])]
    a2 = a + rng.choices(a, k=50)
    want = brute(a2, b)
    assert want and run(spark, a2, b) == want
    assert run(spark, a2, b, leaf_rows=1, step=1) == want
    assert run(spark, a2, b, leaf_rows=2, step=3) == want
    assert run(spark, a2, a2[::-1], leaf_rows=1) == []


def test_edges(spark):
    t = datetime(2030, 1, 1)
    row = ("f", 1, None, "x" * 200000, t, "s", 1)
    assert run(spark, [row], []) == ["('f', 1, 'only_left')"]
    assert run(spark, [], []) == []
    assert run(spark, [row], [("f", 1, "", "x" * 199999 + "y", t, "s", 1)]) == ["('f', 1, 'text')", "('f', 1, 'type')"]
    assert run(spark, [(*row[:4], None, "s", 1), row], [row]) == []


def test_the_walk_follows_the_tree(spark):
    """A leaf under a range whose checksum agrees is not looked at; without the walk it would be found."""
    leaves = spark.createDataFrame([(i, 0, 0, 0) for i in range(64)], "__leaf bigint, n bigint, x1 bigint, x2 bigint")
    odd = F.when(F.col("__leaf") == 5, 7).when(F.col("__leaf") == 40, 11).when(F.col("__leaf").isin(20, 21), 9).otherwise(0).cast("bigint")
    levels = checksum_tree(leaves.withColumn("x1", odd), 6, 2)
    assert [x.count() for x in levels] == [64, 16, 4, 1]
    # 20 and 21 lie in one range, and equal checksums cancel there
    assert sorted(r[0] for r in differing_leaves(levels, 6, 2).collect()) == [5, 40]
    assert differing_leaves(checksum_tree(leaves, 6, 4), 6, 4).count() == 0


def test_values_are_read_in_differing_ranges_only(spark, monkeypatch):
    t = datetime(2030, 1, 1)
    a = [(f"f{i}", i, "a", "x", t, "s", 1) for i in range(400)]
    b = [(*r[:3], "y" if r[1] == 77 else "x", *r[4:]) for r in a]
    seen = []
    walk = reconcile.differing_leaves
    monkeypatch.setattr(reconcile, "differing_leaves", lambda *x: seen.append(walk(*x)) or seen[-1])
    assert run(spark, a, b, leaf_rows=8, step=3) == ["('f77', 77, 'text')"]
    assert seen[0].count() == 1
    monkeypatch.setattr(reconcile, "_BROADCAST_LEAVES", 0)
    assert run(spark, a, b, leaf_rows=8, step=3) == ["('f77', 77, 'text')"]
