import json
import random

import pyarrow as pa

from ferial.operators.nested import flatten_batch, flatten_forms


def brute(body):
    try:
        doc = json.loads(body)
    except (ValueError, TypeError):
        return []
    if not isinstance(doc, dict):
        return []
    out = []

    def esc(k):
        return k.replace("~", "~0").replace("/", "~1")

    def seg(s, at, parent):
        if not isinstance(s, dict):
            return
        t = s.get("type")
        t = t if isinstance(t, str) else None
        key = s.get("key") if t == "shared" and isinstance(s.get("key"), str) else ""
        out.append((at, parent, t or "", key))
        if t == "alternatives" and isinstance(s.get("groups"), list):
            for i, g in enumerate(s["groups"]):
                p = f"{at}/groups/{i}"
                if isinstance(g, dict):
                    out.append((p, at, "group", ""))
                    if isinstance(g.get("segments"), list):
                        for j, x in enumerate(g["segments"]):
                            seg(x, f"{p}/segments/{j}", p)
                elif isinstance(g, list):
                    out.append((p, at, "group", ""))
                    for j, x in enumerate(g):
                        seg(x, f"{p}/{j}", p)

    def section(v, at):
        if isinstance(v, list):
            for i, s in enumerate(v):
                seg(s, f"{at}/{i}", "")
        elif isinstance(v, dict):
            if isinstance(v.get("type"), str):
                seg(v, at, "")
            else:
                for k, x in v.items():
                    section(x, f"{at}/{esc(k)}")

    for k, v in doc.items():
        section(v, f"/{esc(k)}")
    return sorted(out)


def got(bodies):
    b = flatten_batch(pa.array(range(len(bodies))), pa.array(bodies, type=pa.string()))
    out = {i: [] for i in range(len(bodies))}
    for r in b.to_pylist():
        out[r["__id"]].append((r["node"], r["parent"], r["kind"], r["shared_key"]))
    return [sorted(out[i]) for i in range(len(bodies))]


HAND = [
    '{"title":"a","litany":[{"type":"leader","text":"x, [y] {z} \\"q\\" \\\\"}, null, 3, {"type":"shared","key":"k/1~2"}]}',
    '{"a/b~c":{"type":"alternatives","groups":[[{"type":"leader"}],null,{"label":null,"segments":null},{"segments":[{"key":"no","type":"rubric"},{"type":"shared","key":"\\u00e9\\n"}]}]}}',
    '{"s":{"morning":{"x":[{"type":"shared","key":null}]},"evening":[]},"empty":{},"none":null,"e":[],"str":"[{"}',
    '{"s":[{"type":"leader","note":{"type":"shared","key":"z","groups":[[]]},"groups":[[{"type":"label"}]]}]}',
    '{"s":[{"text":"no type"},{"type":null},{"type":7}]}',
    '{ "s" : [ { "groups" : [ { "segments" : [ ] } ] , "type" : "alternatives" } ] }',
    '{"\\u0073ec":[{"type":"a"}]}',
    None, "", "null", "[1]", "{", '{"a":[}', '{"a":"b', "{}", '{"é":[{"type":"λ"}]}',
]


def test_hand_written_bodies():
    assert got(HAND) == [brute(b) if b else [] for b in HAND]


def test_random_bodies():
    rng = random.Random(5)

    def text():
        return "".join(rng.choice('ab"\\{}[],:/~ é\n') for _ in range(rng.randint(0, 6)))

    def seg(d):
        t = rng.choice(["leader", "shared", "alternatives", "alternatives", None])
        s = {"text": text()}
        if t:
            s["type"] = t
        if t == "shared":
            s["key"] = rng.choice([text(), None])
        if t == "alternatives" and d < 4:
            s["groups"] = rng.choice([None, [group(d + 1) for _ in range(rng.randint(0, 3))]])
        items = list(s.items())
        rng.shuffle(items)
        return dict(items)

    def group(d):
        segs = [seg(d) for _ in range(rng.randint(0, 3))]
        return rng.choice([segs, {"label": text(), "segments": segs}, {"segments": None}, None])

    def section(d=0):
        return rng.choice([[seg(0) for _ in range(3)], seg(0), None, [], {}, {text() or "k": section(d + 1) for _ in range(2)} if d < 2 else []])

    bodies = [json.dumps({text() + str(k): section() for k in range(rng.randint(0, 4))}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for _ in range(400)]
    assert got(bodies) == [brute(b) for b in bodies]


def test_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, HAND[0], 9, "n"), (1, HAND[0], 9, "n"), (None, HAND[5], 1, "n"), (2, None, 1, "n")], "form_id int, body string, kind int, node string")
    rows = flatten_forms(df).collect()
    assert sorted((r.form_id or 0, r.node) for r in rows) == [(0, "/s/0"), (0, "/s/0/groups/0"), (1, "/litany/0"), (1, "/litany/3")]
    assert flatten_forms(df.limit(0)).count() == 0
