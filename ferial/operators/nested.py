"""Nested JSON documents turned into flat parent-child tables by kernels over Arrow buffers.

A whole batch of documents is read as one byte buffer with list offsets. Kernels over the buffer
find the structural characters outside strings, give every container its depth (a running sum),
its parent (one binary search for each depth level), its place in the parent (counting commas) and its
member name (the string before the colon). No document is parsed row by row; keys of parents reach the
children by vectorised ``take``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE, _BODY, _SEGLIST, _BRANCHES, _SEGMENT, _GROUPLIST, _GROUP, _BAREGROUP = range(8)


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The character buffer of a string array and its offsets, both starting at 0; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """A string array of many slices of ``buf``: one gather."""
    size = stop - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    data = buf[index]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _unescape(tokens: pa.Array) -> pa.Array:
    """JSON string bodies as text; only tokens that hold a backslash are decoded singly."""
    odd = pc.match_substring(tokens, "\\")
    if not pc.any(odd).as_py():
        return tokens
    fixed = [json.loads(f'"{t}"', strict=False) if o else t for t, o in zip(tokens.to_pylist(), odd.to_pylist())]
    fixed = [t.encode("utf-8", "replace").decode() for t in fixed]
    return pa.array(fixed, type=pa.large_string())


def _is(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, word: bytes) -> np.ndarray:
    ok = stop - start == len(word)
    at = np.where(ok, start, 0)
    for k, c in enumerate(word):
        ok &= buf[np.minimum(at + k, len(buf) - 1)] == c
    return ok


class Containers:
    """Containers (objects and arrays) and scalar string members of a batch of JSON documents."""

    def __init__(self, col: pa.Array):
        buf, offsets = _bytes_of(col)
        self.buf, n = buf, len(col)
        slash = buf == 92
        escaped = np.zeros(len(buf), bool)
        if slash.any():
            pos = np.flatnonzero(slash)
            first = np.concatenate(([True], np.diff(pos) > 1))
            run = pos - pos[np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))]
            esc = pos[run % 2 == 0] + 1
            escaped[esc[esc < len(buf)]] = True
        quotes = np.flatnonzero((buf == 34) & ~escaped)
        doc_of = lambda p: np.searchsorted(offsets, p, side="right") - 1
        qdoc = doc_of(quotes)
        marks = np.flatnonzero(np.isin(buf, np.frombuffer(b"{}[],:", np.uint8)))
        before = np.searchsorted(quotes, marks)
        doc = doc_of(marks)
        qstart = np.searchsorted(qdoc, np.arange(n))
        keep = (before - qstart[doc]) % 2 == 0
        marks, doc = marks[keep], doc[keep]
        kind = buf[marks]
        step = np.isin(kind, np.frombuffer(b"{[", np.uint8)).astype(np.int64) - np.isin(kind, np.frombuffer(b"}]", np.uint8))
        level = np.cumsum(step)
        mstart = np.searchsorted(doc, np.arange(n + 1))
        base = np.concatenate(([0], level))[mstart]
        level = level - base[doc]
        # documents whose quotes or brackets don't balance, or whose root is no object, are set apart
        low = np.full(n, 0, np.int64)
        np.minimum.at(low, doc, level)
        ends = np.diff(base) if n else np.zeros(0, np.int64)
        has = np.diff(mstart) > 0
        root = np.zeros(n, bool)
        root[has] = kind[mstart[:-1][has]] == 123
        quoted = np.bincount(qdoc, minlength=n)[:n] % 2 == 0
        self.good = quoted & (low >= 0) & (ends == 0) & root
        keep = self.good[doc]
        marks, doc, kind, level, step = marks[keep], doc[keep], kind[keep], level[keep], step[keep]
        quotes = quotes[self.good[qdoc]]

        opens = step == 1
        self.at, self.doc, self.depth = marks[opens], doc[opens], level[opens]
        self.is_object = kind[opens] == 123
        m = len(self.at)
        inner = np.where(opens, level - 1, level)  # the depth of the container that holds the mark
        self.parent = np.full(m, -1, np.int64)
        holder = np.full(len(marks), -1, np.int64)
        order = np.cumsum(opens) - 1
        self.levels: list[np.ndarray] = []
        for d in range(1, (int(self.depth.max()) if m else 0) + 1):
            here = np.flatnonzero(self.depth == d)
            self.levels.append(here)
            held = np.flatnonzero((inner == d) & (kind != 125) & (kind != 93))
            holder[held] = here[np.searchsorted(self.at[here], marks[held], side="right") - 1]
        own = holder[opens]
        self.parent[:] = own
        del order
        # place in the parent: commas of the same container before it
        size = np.int64(len(buf) + 1)
        comma = kind == 44
        ckey = np.sort(holder[comma] * size + marks[comma])
        p = np.maximum(self.parent, 0)
        self.index = np.searchsorted(ckey, p * size + self.at) - np.searchsorted(ckey, p * size)
        # names: every colon follows its member's name
        colon = kind == 58
        cpos, chold = marks[colon], holder[colon]
        close = np.searchsorted(quotes, cpos) - 1
        self.name_start, self.name_stop = quotes[close - 1] + 1, quotes[close]
        self.member_of, self.colon_at, self._quotes = chold, cpos, quotes
        # the colon of a container that is an object's member: the last one before it
        k = np.searchsorted(cpos, self.at) - 1
        self.colon = np.where((self.parent >= 0) & self.is_object[p], np.maximum(k, 0), -1)

    def string_member(self, name: bytes) -> tuple[np.ndarray, pa.Array]:
        """Per container the value of its member ``name`` where that is a string (of repeated names the last); a mask and the texts."""
        m = len(self.at)
        hit = np.flatnonzero(_is(self.buf, self.name_start, self.name_stop, name)) if len(self.colon_at) else np.zeros(0, np.int64)
        # the value is a string if only blanks stand between the colon and a quote
        q = np.searchsorted(self._quotes, self.colon_at[hit], side="right")
        ok = q + 1 < len(self._quotes)
        hit, q = hit[ok], q[ok]
        blank = np.isin(self.buf, np.frombuffer(b" \t\r\n", np.uint8))
        solid = np.concatenate(([0], np.cumsum(~blank)))
        ok = solid[self._quotes[q]] - solid[self.colon_at[hit] + 1] == 0
        # a later member of that name that is no string hides an earlier one
        start, stop = np.full(m, 0, np.int64), np.full(m, 0, np.int64)
        there = np.zeros(m, bool)
        at = self.member_of[hit]
        start[at] = self._quotes[q] + 1
        stop[at] = np.where(ok, self._quotes[q + 1], self._quotes[q] + 1)
        there[at] = ok
        return there, _unescape(_slices(self.buf, start, stop))

    def named(self, name: bytes) -> np.ndarray:
        """Which containers are the member ``name`` of an object."""
        c = np.maximum(self.colon, 0)
        if not len(self.name_start):
            return np.zeros(len(self.at), bool)
        return (self.colon >= 0) & _is(self.buf, self.name_start[c], self.name_stop[c], name)


def _roles(c: Containers, typed: np.ndarray, alternatives: np.ndarray) -> np.ndarray:
    role = np.full(len(c.at), _NONE, np.int64)
    groups, segments = c.named(b"groups"), c.named(b"segments")
    for d, here in enumerate(c.levels):
        if d == 0:
            role[here] = _BODY
            continue
        up, obj = role[c.parent[here]], c.is_object[here]
        section = (up == _BODY) | (up == _BRANCHES)
        r = np.full(len(here), _NONE, np.int64)
        r[section & ~obj] = _SEGLIST
        r[section & obj] = np.where(typed[here], _SEGMENT, _BRANCHES)[section & obj]
        r[((up == _SEGLIST) | (up == _BAREGROUP)) & obj] = _SEGMENT
        r[(up == _SEGMENT) & groups[here] & ~obj & alternatives[c.parent[here]]] = _GROUPLIST
        r[up == _GROUPLIST] = np.where(obj, _GROUP, _BAREGROUP)[up == _GROUPLIST]
        r[(up == _GROUP) & segments[here] & ~obj] = _SEGLIST
        role[here] = r
    return role


def _pointers(c: Containers, wanted: np.ndarray) -> list[str | None]:
    """JSON pointers (RFC 6901) of the wanted containers; built level by level from the parents'."""
    named = np.flatnonzero(wanted & (c.colon >= 0))
    token = np.char.mod("%d", c.index).astype(object) if len(c.index) else np.zeros(0, object)
    if len(named):
        k = c.colon[named]
        names = _unescape(_slices(c.buf, c.name_start[k], c.name_stop[k]))
        names = pc.replace_substring(pc.replace_substring(names, "~", "~0"), "/", "~1")
        token[named] = names.to_pylist()
    path = np.full(len(c.at), "", object)
    for d, here in enumerate(c.levels):
        if d:
            here = here[wanted[here]]
            path[here] = path[c.parent[here]] + "/" + token[here]
    return path


def flatten_batch(ids: pa.Array, bodies: pa.Array) -> pa.RecordBatch:
    """Rows ``id, node, parent, kind, shared_key`` of the segments and groups in a batch of bodies."""
    c = Containers(bodies)
    typed, type_ = c.string_member(b"type")
    alternatives = pc.equal(type_, "alternatives").to_numpy(zero_copy_only=False) & typed
    shared = pc.equal(type_, "shared").to_numpy(zero_copy_only=False) & typed
    role = _roles(c, typed, alternatives)
    node = (role == _SEGMENT) | (role == _GROUP) | (role == _BAREGROUP)
    path = _pointers(c, role != _NONE)
    # nearest enclosing segment or group
    near = np.full(len(c.at), -1, np.int64)
    for d, here in enumerate(c.levels):
        if d:
            up = c.parent[here]
            near[here] = np.where(node[up], up, near[up])
    rows = np.flatnonzero(node)
    parent = np.where(near[rows] >= 0, path[np.maximum(near[rows], 0)], "") if len(rows) else np.zeros(0, object)
    kind = pc.if_else(pa.array(role[rows] == _SEGMENT), type_.take(pa.array(rows)), pa.scalar("group", pa.large_string()))
    haskey, key = c.string_member(b"key")
    keys = pc.if_else(pa.array((haskey & shared)[rows]), key.take(pa.array(rows)), pa.scalar("", pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(c.doc[rows])),
            pa.array(path[rows], type=pa.string()),
            pa.array(parent, type=pa.string()),
            kind.cast(pa.string()),
            keys.cast(pa.string()),
        ],
        names=["__id", "node", "parent", "kind", "shared_key"],
    )


def flatten_forms(df: DataFrame, id_col: str = "form_id", body_col: str = "body", version: str | None = None) -> DataFrame:
    """One row per segment and per group of every distinct document.

    ``node`` and ``parent`` are JSON Pointers; ``parent`` is that of the nearest enclosing segment or
    group, or empty. Defined results: a document delivered again counts once, by its latest version where ``version``
    is given; null, malformed or non-object bodies give no rows; null sections, groups and segments
    lists hold nothing; a segment without a type has kind ''; other columns are ignored.
    """
    src = df.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{body_col}`").alias("__body"),
        (F.col(f"`{version}`") if version else F.lit(None).cast("timestamp")).alias("__at"),
    )
    if version:
        src = src.groupBy("__id").agg(F.max(F.struct("__at", "__body")).getField("__body").alias("__body"))
    else:
        src = src.select("__id", "__body").dropDuplicates(["__id"])
    id_type = src.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield flatten_batch(part.column(0), part.column(1))

    return src.mapInArrow(run, f"__id {id_type}, node string, parent string, kind string, shared_key string").withColumnRenamed("__id", id_col)
