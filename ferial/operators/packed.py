"""Several values packed in one field, split by a small parsing expression grammar.

::

    field    <- blank* (entry (divider entry)*)? blank* eof
    entry    <- quoted / bracketed / bare
    quoted   <- '"' ( '""' / !'"' . )* '"' &end / "'" (!("'" &end) .)* "'" &end / '“' (!'”' .)* '”' &end
              / '‘' (!('’' &end) .)* '’' &end / '«' (!'»' .)* '»' &end / '„' (!('“' / '”') .)* ('“' / '”') &end
    bracketed<- balanced (...) or [...], then bare text up to the next divider
    bare     <- (bracketed / !divider .)*
    divider  <- '<br' blank* '/'? '>' / line break / tab / '|' / '•' / '；' / ';' not closing an entity / blank '/' blank
    end      <- blank* (divider / eof)

Alternatives are ordered. A quotation mark without its partner before a divider or the end makes
``quoted`` fail; the parser backtracks and reads the same characters as ``bare``, flagged
``malformed_quote``. An opening bracket without its partner likewise (``malformed_bracket``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DIV = r"(?:<br\s*/?>|\r\n|[\n\r\t|•；;]|(?<=\s)/(?=\s))"
_DIVIDER = re.compile(_DIV, re.IGNORECASE)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_END = re.compile(rf"\s*(?:{_DIV}|\Z)", re.IGNORECASE)
_BLANK = re.compile(r"[^\S\n\r\t]*")
_DOUBLE = re.compile(r'"((?:""|[^"])*+)"')
_MARKED = {"“": re.compile(r"“([^”]*+)”"), "«": re.compile(r"«([^»]*+)»"), "„": re.compile(r"„([^“”]*+)[“”]")}
_SINGLE = {"'": "'", "‘": "’"}
_STOP = re.compile(r"[(\[&]|" + _DIV, re.IGNORECASE)
_BRACKET = re.compile(r"[()\[\]]")
_PAIR = {"(": ")", "[": "]"}


def _quoted(s: str, i: int) -> tuple[int, str] | None:
    mark = s[i : i + 1]
    if mark == '"':
        m = _DOUBLE.match(s, i)
        if m and _END.match(s, m.end()):
            return m.end(), m.group(1).replace('""', '"')
    elif mark in _MARKED:
        m = _MARKED[mark].match(s, i)
        if m and _END.match(s, m.end()):
            return m.end(), m.group(1)
    elif mark in _SINGLE:
        close = _SINGLE[mark]
        j = s.find(close, i + 1)
        while j >= 0:
            if _END.match(s, j + 1):
                return j + 1, s[i + 1 : j]
            j = s.find(close, j + 1)
    return None


def _partners(s: str) -> dict[int, int]:
    """Where each bracket that has a partner is closed; one pass."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for m in _BRACKET.finditer(s):
        c = m.group()
        if c in _PAIR:
            open_.append((_PAIR[c], m.start()))
        elif open_ and c == open_[-1][0]:
            out[open_.pop()[1]] = m.end()
    return out


def _bare(s: str, i: int, partners: dict[int, int]) -> tuple[int, bool]:
    """Reads to the next divider outside balanced brackets; True where a bracket has no partner."""
    bad = False
    while m := _STOP.search(s, i):
        c = m.group()
        if c in _PAIR:
            bad |= m.start() not in partners
            i = partners.get(m.start(), m.end())
        elif c == "&":
            e = _ENTITY.match(s, m.start())
            i = e.end() if e else m.end()
        else:
            return m.start(), bad
    return len(s), bad


def split_packed(text: str | None, keep_or: bool = False) -> list[tuple[int, str, str]]:
    """``(pos, piece, flag)`` for every value of a packed field; flag is empty, or names what was malformed.

    ``keep_or`` leaves a bare ``Or`` in the list, so that branches can be told apart.
    """
    if not text:
        return []
    out: list[tuple[int, str, str]] = []
    i, n, partners = 0, len(text), _partners(text)
    while i <= n:
        i = _BLANK.match(text, i).end()
        flag, q = "", _quoted(text, i)
        if q:
            i, piece = q
            i = _BLANK.match(text, i).end()
        else:
            end, bad = _bare(text, i, partners)
            flag = "malformed_quote" if text[i : i + 1] in ('"', "“", "«", "„", "‘") else "malformed_bracket" if bad else ""
            piece, i = text[i:end], end
        piece = piece.strip()
        if piece and (keep_or or q or piece.lower() != "or"):
            out.append((len(out) + 1, piece, flag))
        m = _DIVIDER.match(text, i)
        if not m:
            if i >= n:
                break
            continue
        i = m.end()
    return out


@F.pandas_udf(StringType())
def unpacked(c: pd.Series) -> pd.Series:
    """A packed field with each value on a line of its own, without the marks around it; a bare ``Or`` is a line ``Or``."""

    def lay(text: str | None) -> str | None:
        if text is None:
            return None
        pieces = (" ".join(p.split()) for _, p, _ in split_packed(text, keep_or=True))
        return "\n".join("Or" if p.lower() == "or" else p for p in pieces)

    return c.map(lay)


_PIECES = pa.list_(pa.struct([("pos", pa.int32()), ("piece", pa.string()), ("flag", pa.string())]))


def explode_packed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Rows ``id_col, field, pos, piece, flag``: one per value of every packed field.

    Defined results: null, empty and blank fields give no rows; entries that are empty and a bare
    ``Or`` take no position; repeated rows (equal id) count once; other columns are ignored.
    """
    src = df.select(F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{f}`").alias(f"__f{k}") for k, f in enumerate(fields)])
    src = src.dropDuplicates(["__id"])
    id_type = src.schema["__id"].dataType

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(0)]
            for k in range(len(fields)):
                vals = [[{"pos": p, "piece": v, "flag": g} for p, v, g in split_packed(t)] for t in b.column(k + 1).to_pylist()]
                cols.append(pa.array(vals, type=_PIECES))
            yield pa.RecordBatch.from_arrays(cols, names=["__id", *[f"__f{k}" for k in range(len(fields))]])

    piece = "array<struct<pos:int,piece:string,flag:string>>"
    parsed = src.mapInArrow(parse, f"__id {id_type.simpleString()}, " + ", ".join(f"__f{k} {piece}" for k in range(len(fields))))
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__f{k}").alias("v")) for k, f in enumerate(fields)])
    return (
        parsed.select(F.col("__id"), F.explode(tagged).alias("t"))
        .select("__id", "t.field", F.inline("t.v"))
        .withColumnRenamed("__id", id_col)
    )
