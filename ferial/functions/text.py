"""Text columns: cleaning, display and quality predicates. All expressions stay in the JVM but for the two at the end."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_SPACE = r"(?U)\s+"
# fixed values: the named entities decoded by expression; &amp; last, so that nothing is decoded twice
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The usual named entities decoded (``unescape_all`` knows every one)."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip(c: Column) -> Column:
    """``c`` without blanks of any kind and line breaks at its ends."""
    return F.regexp_replace(c, "^[\\s\\x0B\\p{Z}\uFEFF]+|[\\s\\x0B\\p{Z}\uFEFF]+$", "")


def squash(c: Column) -> Column:
    """Every run of white space (no-break spaces too) one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def clean(c: Column) -> Column:
    """``<br>`` to line feeds, other tags dropped, entities decoded, trimmed."""
    lines = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(unescape(strip_tags(lines)), r"(?U)^\s+|\s+$", "")


def clean_inline(c: Column) -> Column:
    """As ``clean`` on one line."""
    return squash(unescape(strip_tags(F.regexp_replace(c, r"(?i)<br\s*/?>", " "))))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def first_line(c: Column) -> Column:
    """The first line that is not blank, else the text itself."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), c)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def bind_midpoint(c: Column) -> Column:
    """The asterisk of a verse bound to the word before it by a no-break space."""
    return F.regexp_replace(c, r"(\S+)[ \t]*\*", "$1\u00a0*")


def mark_placeholder(c: Column, mark: str = "(N)") -> Column:
    """The bare ``N`` that stands for a name."""
    return F.regexp_replace(c, r"\bN\b(?=[ ,.])", mark)


def line_id(c: Column) -> Column:
    """Ten hex digits that name a line whatever its blanks and however its accents are composed."""
    return F.left(F.sha2(squash(nfc(c)), 256), F.lit(10))


def straighten_quotes(c: Column) -> Column:
    straight = F.translate(c, "“”‘’", "\"\"''")
    return F.regexp_replace(straight, r'(?m)(^|[\s(])" +(?=\S)', '$1"')


def title_rank(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def read_more_cut(c: Column, keep: int = 80, limit: int = 100) -> Column:
    """The text cut at the last blank within ``keep`` characters where it is longer than ``limit``."""
    head = F.left(c, F.lit(keep + 1))
    at = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(c) <= limit, c).when(F.locate(" ", head) == 0, F.left(c, F.lit(keep))).otherwise(F.rtrim(F.substring(c, 1, at)))


def split_name_body(c: Column) -> Column:
    """``Name: body`` as a struct; no name where there is no such opening."""
    name = F.regexp_extract(c, r"(?s)^([^:\n]{1,60}):\s+(.+)$", 1)
    body = F.regexp_extract(c, r"(?s)^([^:\n]{1,60}):\s+(.+)$", 2)
    return F.when(name != "", F.struct(name.alias("name"), body.alias("body"))).otherwise(F.struct(F.lit(None).cast("string").alias("name"), c.alias("body")))


def split_amen(c: Column) -> Column:
    """A leader's text and the response ``Amen.`` that closes it."""
    body = F.regexp_extract(c, r"(?s)^(.+)\s(Amen\.)$", 1)
    return F.when(body != "", F.array(body, F.lit("Amen."))).otherwise(F.array(c))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(None)).otherwise(F.format_string("%.1f%%", part * 100.0 / whole))


def dehyphenate(c: Column, keep: list[tuple[str, str]] = ()) -> Column:
    """Words that a line end divides put together again; the hyphen stays before a capital and in the pairs of ``keep``."""
    out = F.regexp_replace(c, r"([A-Za-z]+)-\n(?=[A-Z])", "$1-")
    for a, b in keep:
        out = F.regexp_replace(out, rf"(?<![A-Za-z]){a}-\n{b}(?![A-Za-z])", f"{a}-{b}")
    return F.regexp_replace(out, r"([A-Za-z])-\n([a-z])", "$1$2")


def undouble(c: Column) -> Column:
    """Words of three letters or more that stand twice in a row, once."""
    return F.regexp_replace(c, r"(?i)\b(\w{3,})\s+\1\b", "$1")


def plain_citation(c: Column) -> Column:
    """A citation with colons for points, an em dash across chapters and hyphens within one."""
    dotted = F.regexp_replace(c, r"(\d)\.(\d)", "$1:$2")
    return F.replace(F.regexp_replace(dotted, r"(?<=\d)[a-c]?–(?=\d+:)", "—"), F.lit("–"), F.lit("-"))


def grams(c: Column, size: int) -> Column:
    """All runs of ``size`` characters, up to three. By slices of the characters: places in a text would be counted from its start each time."""

    def joined(chars: Column) -> Column:
        n = F.greatest(F.size(chars) - (size - 1), F.lit(0))
        out = F.slice(chars, F.lit(1), n)
        for k in range(2, size + 1):
            out = F.zip_with(out, F.slice(chars, F.lit(k), n), lambda a, b: F.concat(a, b))
        return out

    # a list of one, so that the characters are taken once
    return F.flatten(F.transform(F.array(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), joined))


# quality predicates


def missing_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\b(?:Mc|Mac)(?=[A-Z])", "").rlike(r"[a-z][A-Z]")


def duplicate_word(c: Column) -> Column:
    return c.rlike(r"(?i)\b([a-z]+)\s+\1\b")


def long_token(c: Column, n: int = 30) -> Column:
    return c.rlike(rf"[a-z]{{{n},}}")


def hanging_hyphen(c: Column) -> Column:
    return c.rlike(r"[a-z]-\s+[a-z]")


def garbled(c: Column) -> Column:
    return c.rlike(r"[a-z]{14,}")


def quality_findings(c: Column, identifiers: tuple[str, ...] = (), hyphened: tuple[str, ...] = ()) -> Column:
    """The faults of a text, each once: ``missing_space`` in a line that is no label in capitals, no citation and none of ``identifiers`` (names in
    Mc or Mac pass), ``duplicate_word`` of three letters or more, ``long_token`` of thirty, ``hanging_hyphen`` at a line's end but for the words of ``hyphened``."""
    known = "|".join(identifiers) or r"(?!)"
    kept = F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.rlike(r"^[A-Z]{2,}$") & ~x.rlike(r"\b\d+:\d+"))
    spaced = F.exists(kept, lambda x: F.regexp_replace(x, rf"\b(?:Mc|Mac)(?=[A-Z])|\b(?:{known})\b", "").rlike(r"[a-z][A-Z]"))
    hung = F.regexp_replace(c, rf"\b(?:{'|'.join(hyphened)})-(?=\s*\n)", "") if hyphened else c
    tests = {"missing_space": spaced, "duplicate_word": c.rlike(r"(?i)\b(\w{3,})\s+\1\b"), "long_token": c.rlike(r"\b[a-z]{30,}\b"), "hanging_hyphen": hung.rlike(r"\w-\s*\n")}
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def wrapped_lines(c: Column) -> Column:
    """Inner lines of prose that end in no mark: a column wrap left in the text."""
    inner = F.slice(lines(c), 1, F.greatest(F.size(lines(c)) - 1, F.lit(0)))
    return F.filter(inner, lambda x: (F.trim(x) != "") & ~x.rlike(r"[,;:.!?—’”)]\s*$"))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlaps; 0 for an empty part."""
    return F.when(F.length(part) == 0, 0).otherwise(F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)))


# no built-in of the engine does these


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def unescape_all(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters (longest matching blocks) in 0..1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
