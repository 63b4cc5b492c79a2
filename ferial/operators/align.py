"""Two word streams of one text aligned: words that differ, and line breaks that one side has and the other lacks."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NOT_KEY = re.compile(r"[^a-z0-9']")


def word_stream(text: str) -> list[tuple[str, str, bool]]:
    """``(word, key, ends its line)`` of every word with letters or digits; asterisks divide words, the last line ends nothing."""
    out: list[tuple[str, str, bool]] = []
    for line in text.split("\n"):
        words = [(w, _NOT_KEY.sub("", w.lower().replace("’", "'").replace("‘", "'"))) for w in line.replace("*", " ").split()]
        words = [x for x in words if x[1]]
        out += [(w, k, i == len(words) - 1) for i, (w, k) in enumerate(words)]
    if out:
        out[-1] = (*out[-1][:2], False)
    return out


def differences(ours: list[str], theirs: str, anchor: int = 3) -> list[tuple[str, str, str]]:
    """``(kind, ours, theirs)`` of our segments against their text.

    Blocks of equal words are found longest first. Without a block of ``anchor`` words the texts are ``UNALIGNED``. Between the first and the last
    such block every other change is ``WORDING``; inside blocks a line break only they have is ``MISSING-BREAK``, one only we have ``EXTRA-BREAK``. The
    end of a segment is no break, for or against.
    """
    a: list[tuple[str, str, bool, bool]] = []
    for s in ours:
        stream = word_stream(s)
        a += [(w, k, b, i == len(stream) - 1) for i, (w, k, b) in enumerate(stream)]
    b = word_stream(theirs)
    if not b:
        return []
    ops = difflib.SequenceMatcher(None, [x[1] for x in a], [x[1] for x in b], autojunk=False).get_opcodes()
    fixed = [o for o in ops if o[0] == "equal" and o[2] - o[1] >= anchor]
    if not fixed:
        return [("UNALIGNED", "", " ".join(x[0] for x in b[:8]))]
    low, high = fixed[0][1], fixed[-1][2]
    text = lambda words: " ".join(w[0] for w in words)
    out = []
    for op, i, j, m, n in ops:
        if op == "equal":
            # the last word of a block has no common word after it
            for x, y in zip(range(i, j - 1), range(m, n - 1)):
                if not a[x][3] and a[x][2] != b[y][2]:
                    out.append(("MISSING-BREAK" if b[y][2] else "EXTRA-BREAK", text(a[max(i, x - 5) : x + 1]), text(b[y + 1 : y + 6])))
        elif low <= i and j <= high:
            out.append(("WORDING", text(a[i:j]), text(b[m:n])))
    return out


def align(df: DataFrame, id_col: str, ours: str, theirs: str, anchor: int = 3) -> DataFrame:
    """``id, kind, ours, theirs`` of every row with ``ours``, an array of segments, and ``theirs``, a text. Nulls count as empty.

    Longest matching blocks have no relational form, so this is Python over Arrow batches, a row at a time; rows are independent.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, x, y in zip(b["id"], b["ours"], b["theirs"]):
                segments = [] if x is None else [s for s in x if isinstance(s, str)]
                rows += [(i, *f) for f in differences(segments, y if isinstance(y, str) else "", anchor)]
            yield pd.DataFrame(rows, columns=["id", "kind", "ours", "theirs"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{ours}` AS ours", f"`{theirs}` AS theirs")
    return src.mapInPandas(run, f"id {kind}, kind string, ours string, theirs string").withColumnRenamed("id", id_col)


def undeclared(findings: DataFrame, declared: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Wording findings that no declaration ``(on…, reads)`` covers (``—`` reads nothing), with all other findings; and the declarations
    that cover none."""
    from pyspark.sql import functions as F

    d = declared.select(*on, F.when(F.col("reads") == "—", "").otherwise(F.col("reads")).alias("theirs"), "reads").withColumn("kind", F.lit("WORDING"))
    keys = [*on, "kind", "theirs"]
    return findings.join(d.select(*keys).distinct(), keys, "left_anti"), d.join(findings.select(*keys).distinct(), keys, "left_anti").select(*on, "reads")
