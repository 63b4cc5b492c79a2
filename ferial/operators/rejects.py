"""Loading raw comma-separated records while setting failing ones apart with the reason.

The parse is a minimum-cost error parse: a dynamic program over (place, parser state, delimiters so far) in
which quotes and delimiters may be inserted or deleted. Costs are compared in this order: edits that mend the
quoting, edits that mend the number of fields, then fields whose value is invalid. A record whose parse costs nothing is
loaded; otherwise the edits of the cheapest parse are the reason. Without edits the program has one path only,
which a scan by regular expressions follows (``free_path``); the table is filled for the records that path rejects, for all
of a batch at once, one step for each quote, delimiter or run of other characters.

A delimiter put in where the quoting rules ask for one (after a closing quote, or before a quote inside a bare
field) mends the quoting, so its cost counts there too. Hence the cheapest parse has no quoting cost exactly where the record
keeps the quoting rules, and no delimiter cost exactly where it also has a fitting number of fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: what counts as blank around a value; control characters do not, they make a value invalid
_BLANKS = " \t\r\n\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# a blank before an opening or after a closing quote is an ordinary character, so the field is not a quoted one
_CLOSED = re.compile(r'"((?:""|[^"])*+)"(?=,|\Z)')
_OPEN = re.compile(r'[^",]*+(?=,|\Z)')
_TOKEN = re.compile(r'[",]|[^",]+')

_START, _BARE, _QUOTED, _CLOSE = range(4)
_QUOTE, _DELIMITER, _RUN, _END = range(4)
_FIELD, _QUOTING = 1, 1 << 24  # one quoting edit outweighs any number of delimiters
_INF = np.int64(1 << 60)
_BLOCK_CHARS = 200_000


def free_path(record: str) -> list[str] | None:
    """The fields along the path of the dynamic program that edits nothing, None where that path breaks off."""
    out, i, n = [], 0, len(record)
    while True:
        m = _CLOSED.match(record, i)
        if m:
            out.append(m.group(1).replace('""', '"'))
        else:
            m = _OPEN.match(record, i)
            if not m:
                return None
            out.append(m.group(0))
        i = m.end()
        if i >= n:
            return out
        i += 1


def _relax(cost: np.ndarray, a: int, b: int, price: np.ndarray | int, shift: bool = False) -> None:
    """An insertion before the next token: state a becomes b, one delimiter further where ``shift``."""
    if not shift:
        np.minimum(cost[:, b], cost[:, a] + price, out=cost[:, b])
        return
    add = price[:, None] if isinstance(price, np.ndarray) else price
    np.minimum(cost[:, b, 1:], cost[:, a, :-1] + add, out=cost[:, b, 1:])


def _insertions(cost: np.ndarray, kind: np.ndarray) -> list[tuple[int, int, np.ndarray | int, bool]]:
    """All insertions that may stand before a token of ``kind``, in the order in which they are tried."""
    before_quote = np.where(kind == _QUOTE, _QUOTING + _FIELD, _FIELD).astype(np.int64)
    after_close = np.where((kind == _QUOTE) | (kind == _RUN), _QUOTING + _FIELD, _FIELD).astype(np.int64)
    quotes = [(_START, _QUOTED, _QUOTING, False), (_QUOTED, _CLOSE, _QUOTING, False), (_CLOSE, _QUOTED, _QUOTING, False)]
    marks = [(_BARE, _START, before_quote, True), (_CLOSE, _START, after_close, True)]
    empty = [(_START, _START, _FIELD, True)] * (cost.shape[2] - 1)
    return [*quotes, *marks, *empty, quotes[0], quotes[1]]


_MOVES = {  # (token, state): the state after it, whether a delimiter is counted
    (_QUOTE, _START): (_QUOTED, False), (_QUOTE, _QUOTED): (_CLOSE, False), (_QUOTE, _CLOSE): (_QUOTED, False),
    (_DELIMITER, _START): (_START, True), (_DELIMITER, _BARE): (_START, True), (_DELIMITER, _CLOSE): (_START, True), (_DELIMITER, _QUOTED): (_QUOTED, False),
    (_RUN, _START): (_BARE, False), (_RUN, _BARE): (_BARE, False), (_RUN, _QUOTED): (_QUOTED, False),
}
_DELETE = {_QUOTE: _QUOTING, _DELIMITER: _FIELD}


def least_edits(records: list[str], least: int, most: int) -> list[tuple[int, list[str]]]:
    """``(cost, edits)`` of the cheapest parse of every record into ``least`` to ``most`` fields.

    Each edit reads ``insert "@i``, ``delete "@i``, ``insert ,@i`` or ``delete ,@i`` (0-based place in the record).
    Time and memory are linear in the record.
    """
    spans = [[m.span() for m in _TOKEN.finditer(r)] for r in records]
    kinds = np.full((max(map(len, spans), default=0) + 1, len(records)), _END, np.int64)
    for i, (r, s) in enumerate(zip(records, spans)):
        kinds[: len(s), i] = [_QUOTE if r[a] == '"' else _DELIMITER if r[a] == "," else _RUN for a, _ in s]
    cost = np.full((len(records), 4, most), _INF)
    cost[:, _START, 0] = 0
    table = [cost]  # before the insertions at each token
    for kind in kinds[:-1]:
        here = cost.copy()
        for step in _insertions(here, kind):
            _relax(here, *step)
        after = np.full_like(cost, _INF)
        for token in (_QUOTE, _DELIMITER, _RUN):
            rows = kind == token
            if rows.any():
                old = here[rows]
                new = np.minimum(old + _DELETE[token], _INF) if token in _DELETE else np.full_like(old, _INF)
                for (t, a), (b, counted) in _MOVES.items():
                    if t == token:
                        target, source = (new[:, b, 1:], old[:, a, :-1]) if counted else (new[:, b], old[:, a])
                        np.minimum(target, source, out=target)
                after[rows] = new
        after[kind == _END] = cost[kind == _END]
        cost = after
        table.append(cost)
    return [_trace(r, s, kinds[:, i], [c[i : i + 1] for c in table[: len(s) + 1]], least) for i, (r, s) in enumerate(zip(records, spans))]


def _trace(record: str, spans: list[tuple[int, int]], kinds: np.ndarray, table: list[np.ndarray], least: int) -> tuple[int, list[str]]:
    """Walks the table of one record back from its cheapest end."""
    edits: list[str] = []
    total = s = k = None
    for t in range(len(spans), -1, -1):
        kind = kinds[t : t + 1] if t < len(spans) else np.array([_END])
        steps = _insertions(table[t], kind)
        states = [table[t]]
        for step in steps:
            states.append(states[-1].copy())
            _relax(states[-1], *step)
        if total is None:
            ends = [(int(states[-1][0, x, y]), x, y) for x in (_START, _BARE, _CLOSE) for y in range(least - 1, table[t].shape[2])]
            total, s, k = min(ends)
        else:
            # undo the move over token t
            token, before, cost = int(kinds[t]), states[-1][0], int(table[t + 1][0, s, k])
            for (tk, a), (b, counted) in _MOVES.items():
                if tk == token and b == s and k >= counted and int(before[a, k - counted]) == cost:
                    s, k = a, k - counted
                    break
            else:
                edits.append(f"delete {record[spans[t][0]]}@{spans[t][0]}")
        at = spans[t][0] if t < len(spans) else len(record)
        for (a, b, _, counted), old, new in zip(reversed(steps), states[-2::-1], states[:0:-1]):
            if b == s and new[0, s, k] < old[0, s, k]:
                edits.append(f"insert {',' if counted else chr(34)}@{at}")
                s, k = a, k - counted
    return total, edits[::-1]


@dataclass(frozen=True)
class RecordContract:
    """Names of the fields in order, how many of the last may be absent, and the value checks in report order."""

    fields: tuple[str, ...]
    optional: int
    checks: tuple[tuple[str, Callable[[str], bool]], ...]


_BAD_CHARS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
# fixed values of the calendar contract
_COLOUR = "(?:White|Red|Green|Violet|Rose|Blue)"
_OBSERVANCE = re.compile(rf"(.*?)(?: - (?:PF|HD|Mem|Com))?(?: \({_COLOUR}(?:/{_COLOUR})?\))?", re.DOTALL)
_NOTE = re.compile(r"\[(?:pastoral|source|antiphon|rubric)\] \S.*", re.DOTALL)


def valid_date(v: str) -> bool:
    if not _DATE.fullmatch(v):
        return False
    try:
        date.fromisoformat(v)
    except ValueError:
        return False
    return True


def _valid_title(line: str) -> bool:
    title = _OBSERVANCE.fullmatch(line).group(1)
    return bool(title.strip(_BLANKS)) and not title.startswith("- ") and " - " not in title and not any(c in "()[]" for c in title)


def valid_name(v: str) -> bool:
    return not _BAD_CHARS.search(v) and all(map(_valid_title, v.split("<br>")))


def valid_eucharist(v: str) -> bool:
    return not v or (not _BAD_CHARS.search(v) and v.startswith("Collect of the Day: ") and v.endswith("Amen."))


def valid_extra(v: str) -> bool:
    return not v or (not _BAD_CHARS.search(v) and all(_NOTE.fullmatch(x) for x in v.split("<br>")))


CALENDAR = RecordContract(
    ("cal_date", "name", "eucharist", "morning", "evening", "extra"),
    1,
    (("cal_date", valid_date), ("name", valid_name), ("eucharist", valid_eucharist), ("extra", valid_extra)),
)


def _typed_edits(record: str, contract: RecordContract, least: int, most: int) -> list[str] | None:
    """Of the delimiter edits that cost least, those that leave the fewest invalid values, for a record that keeps the quoting rules.

    A second program over (field, slot): neighbours are joined, or slots left empty. None beyond 64 fields,
    where any of the equally cheap edits is as good.
    """
    spans, i = [], 0
    while not spans or i <= len(record):
        m = _CLOSED.match(record, i) or _OPEN.match(record, i)
        spans.append(m.span())
        i = m.end() + 1
    m, n = len(spans), most if len(spans) > most else least
    if m > 64:
        return None
    checks = dict(contract.checks)

    def invalid(a: int, b: int, slot: int) -> bool:
        fields = free_path(record[spans[a][0] : spans[b - 1][1]]) if b > a else [""]
        ok = checks.get(contract.fields[slot])
        return bool(ok) and not ok(",".join(fields).strip(_BLANKS))

    best: dict[tuple[int, int], tuple[int, list[str]]] = {(0, 0): (0, [])}
    for slot in range(n):
        for a in range(m + 1):
            if (a, slot) not in best:
                continue
            cost, edits = best[a, slot]
            sizes = range(1, m - n + 2) if m > n else (1, 0)
            for size in sizes:
                b = a + size
                if b > m or (m > n and m - b < n - slot - 1) or (m < n and m - b > n - slot - 1):
                    continue
                at = spans[a][0] if a < m else len(record)
                more = [f"delete ,@{spans[x][1]}" for x in range(a, b - 1)] if size else [f"insert ,@{at}"]
                new = cost + invalid(a, b, slot)
                if (b, slot + 1) not in best or new < best[b, slot + 1][0]:
                    best[b, slot + 1] = (new, edits + more)
    return best[m, n][1]


@dataclass(frozen=True)
class Verdict:
    """Outcome for one record: its fields where it loads, else the reason, the field and the edits that would mend it."""

    fields: list[str] | None
    reason: str | None = None
    field: str | None = None
    edits: str = ""


def _by_values(fields: list[str], contract: RecordContract) -> Verdict:
    by = dict(zip(contract.fields, fields + [""] * contract.optional))
    for name, ok in contract.checks:
        if not ok(by[name]):
            return Verdict(None, "value", name, f"replace {name}")
    return Verdict(fields)


def _blocks(records: list[str]) -> Iterator[list[str]]:
    """Records of like length together, so that a table is as wide as its records need."""
    block: list[str] = []
    for r in sorted(records, key=len):
        if block and len(r) * (len(block) + 1) > _BLOCK_CHARS:
            yield block
            block = []
        block.append(r)
    if block:
        yield block


def judge(records: list[str | None], contract: RecordContract) -> list[Verdict]:
    """The verdict on every record; the cost of its cheapest parse decides."""
    most, least = len(contract.fields), len(contract.fields) - contract.optional
    out: dict[str, Verdict] = {}
    dear = []
    for r in {x or "" for x in records}:
        fields = free_path(r)
        if fields is not None and least <= len(fields) <= most:
            out[r] = _by_values([f.strip(_BLANKS) for f in fields], contract)
        else:
            dear.append(r)
    for block in _blocks(dear):
        for r, (cost, edits) in zip(block, least_edits(block, least, most)):
            if cost < _QUOTING:
                edits = _typed_edits(r, contract, least, most) or edits
            out[r] = Verdict(None, "quoting" if cost >= _QUOTING else "columns", "row", "; ".join(edits))
    return [out[x or ""] for x in records]


def parse_records(df: DataFrame, id_col: str, raw_col: str, contract: RecordContract = CALENDAR) -> DataFrame:
    """One row per distinct id: the id, every field of the contract, ``reason, field, edits``.

    Defined results: a null record fails as ``columns``, as does an empty one; an absent optional
    field loads as null; a record repeated under the same id counts once; other columns are ignored. Field
    names that clash with the id column are not allowed in the contract.
    """
    src = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{raw_col}`").alias("__raw")).dropDuplicates(["__id"])
    id_type = src.schema["__id"].dataType
    width = len(contract.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", *[f"__f{k}" for k in range(width)], "__reason", "__field", "__edits"]
        for b in batches:
            verdicts = judge(b.column(1).to_pylist(), contract)
            cols = [[v.fields[k] if v.fields and k < len(v.fields) else None for v in verdicts] for k in range(width)]
            cols += [[v.reason for v in verdicts], [v.field for v in verdicts], [v.edits for v in verdicts]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=pa.string()) for c in cols]], names=names)

    schema = f"__id {id_type.simpleString()}, " + ", ".join(f"__f{k} string" for k in range(width)) + ", __reason string, __field string, __edits string"
    out = src.mapInArrow(run, schema)
    return out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__f{k}").alias(f) for k, f in enumerate(contract.fields)],
        F.col("__reason").alias("reason"),
        F.col("__field").alias("field"),
        F.col("__edits").alias("edits"),
    )


def split_good_and_bad(df: DataFrame, id_col: str, raw_col: str, contract: RecordContract = CALENDAR) -> tuple[DataFrame, DataFrame]:
    """``(loaded rows, rejects)``; both are views on the same parse."""
    parsed = parse_records(df, id_col, raw_col, contract)
    good = parsed.where(F.col("reason").isNull()).drop("reason", "field", "edits")
    bad = parsed.where(F.col("reason").isNotNull()).select(id_col, "reason", "field", "edits")
    return good, bad
