"""Sentences and headings of documents in many languages, in SQL expressions only.

Three steps, all regular expressions of the JVM: marks that end nothing (decimals, addresses, initials,
shortened words, ordinals) are masked by placeholders of the private-use area, one for one, so that
places in the text stay what they are; the text is cut by terminators of its scripts, quotations and
parentheses being single atoms; the placeholders are turned back. Pieces tile the text, so starts and ends
are running sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DOT, _HARD, _SOFT = "\ue000", "\ue001", "\ue002"  # masked mark, empty line, blank that ends a Thai unit

# Shortened words that a name or anything follows; that a number, a numeral or a small letter follows;
# that may also stand last in a sentence (they end it before a capital).
_TITLES = (
    "St Sts Ste Mt Abp Bp Rev Revd Dr Mr Mrs Ms Prof Fr Br Sr Sra Srta Sta Sto Dom Hl hl Hr Fr Mme Mlle Mgr Msgr Me cf Cf viz vs bzw ggf vgl Vgl "
    "св Св прп преп Прп им ул Αγ αγ Άγ άγ Οσ δηλ напр Напр д-р"
).split()
_NUMBERED = (
    "ch chap vol Vol v vv p pp fol ff No Nos Nr no nos art cap Cap núm pág aprox approx ca env ok Kap Bd Abs Anm fig Fig sec Sec Ps Pss ps par n "
    "гл стр ок г т разд κεφ σελ στ αρ πίν".split()
)
_LATIN_PAIRS = ("e.g", "i.e", "E.g", "I.e", "p. ex", "p. ej", "p.ej", "z. B", "z.B", "d. h", "d.h", "u. a", "т. е", "т.е", "π.χ", "π. χ", "а.е")
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ue001\ue002"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_OWN_STOP = r"[\p{IsDevanagari}\p{IsBengali}\p{IsEthiopic}\p{IsThai}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
_THAI = r"[ก-ฯะ-\u0e3aเ-ๅ\u0e47-\u0e4e]"
_STOPS = r".!?…．！？。｡।॥።፧፨؟۔‼⁇⁈⁉;;"
_ANY_STOP = r"[.!?…．！？。｡।॥።፧፨؟۔‼⁇⁈⁉;]"
_CLOSERS = r"[”’»）)\]」』›]|\"(?=\s|$|\ue001|\ue002|[,.;:!?])"


def _words(words: list[str] | tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.").replace(" ", r"[ \u00a0\u202f]?") for w in sorted(set(words), key=lambda w: (-len(w), w)))


_NOT_LAST = r"(?!\s*+(?:\ue001|\z))"
# A full stop that ends nothing. The mark comes first and looks behind second, so that only marks are examined.
_IDLE = "|".join(
    (
        # decimals and figures
        r"(?<=\p{N}.)(?=\p{N})",
        # addresses
        r"(?=[\p{Alnum}/])(?<=(?:https?://|www\.)\S{0,200}.)",
        # initials, also right after a letter without case
        rf"(?=\s*+[\p{{L}}\p{{N}}]){_NOT_LAST}(?<=(?<![\p{{Lu}}\p{{Ll}}\p{{Lt}}\p{{M}}])\p{{Lu}}.)",
        r"(?=\s?B[.])(?<=(?<!\p{L})[zZ].)",
        # shortened words
        rf"{_NOT_LAST}(?<=(?<![\p{{L}}\p{{M}}])(?:{_words([*_LATIN_PAIRS, *_TITLES])}).)",
        rf"(?=\s*+(?:\p{{N}}|[IVXLC]++(?!\p{{L}})))(?<=(?<![\p{{L}}\p{{M}}])(?:{_words(_NUMBERED)}).)",
        # a citation: a short capitalised name before a number (but the month)
        r"(?=\s*+\p{N})(?<=(?<![\p{L}\p{M}])(?!May)\p{Lu}\p{Ll}{1,3}.)",
        # ordinals before a month
        rf"(?=\s++(?:{_MONTHS})(?!\p{{L}}))(?<=(?<!\p{{N}})\p{{N}}{{1,2}}.)",
        # scripts with full stops of their own, and single Arabic or Hebrew letters
        rf"{_NOT_LAST}(?<={_OWN_STOP}\p{{M}}?.)",
        rf"{_NOT_LAST}(?<=(?<![\p{{L}}\p{{M}}])[\p{{IsArabic}}\p{{IsHebrew}}].)",
    )
)
_BLANK = r"[ \u00a0\u2000-\u200a\u202f\u3000]"
#: (pattern, placeholder) in order; every pattern matches one character
_MASKS = (
    (r"\n(?=[^\S\n]*+\n)", _HARD),
    # full stops before a small letter end nothing anyway
    (rf"[.．](?!\s*+\p{{Ll}})(?:{_IDLE})", _DOT),
    # blanks that end a Thai unit: between Thai letters, but not at the repetition sign or an era
    (rf"{_BLANK}(?={_BLANK}*+(?:(?![ก-ฮ]\ue000\s?[ก-ฮ]\ue000){_THAI}|[“«](?={_THAI})))(?<=(?:{_THAI}|[”»!?]).)", _SOFT),
)

_QUOTES = (
    r"“[^”\ue001]{0,5000}+”",
    r"„[^“”\ue001]{0,5000}+[“”]",
    r"«[^»\ue001]{0,5000}+»",
    r"‹[^›\ue001]{0,5000}+›",
    r"「[^」\ue001]{0,5000}+」",
    r"『[^』\ue001]{0,5000}+』",
    r"‘[^‘’\ue001]{0,5000}+(?:’(?=\p{L})[^‘’\ue001]{0,5000}+){0,50}+’(?!\p{L})",
    r"(?<![\p{L}\p{N}])\"[^\"\ue001]{0,5000}+\"",
    r"\([^()\ue001]{0,5000}+(?:\([^()\ue001]{0,5000}+\)[^()\ue001]{0,5000}+){0,50}+\)",
    r"（[^（）\ue001]{0,5000}+）",
)
_QUOTE = "(?:" + "|".join(_QUOTES) + ")"
_OPENERS = r"“„«‹「『‘\"(（"
# what follows where the sentence runs on
_ON = r"(?:\s*+[\p{Ll},:،؛、，；)\]]|\s*+;|\p{N}|\s*+[-–—]|\s*+…)"
_END = rf"(?!{_ON})(?=\s|\z|[\ue001\ue002]|[\p{{Lu}}\p{{Lt}}\p{{Lo}}¿¡{_OPENERS}])"
_QUOTE_ENDS = rf"(?<={_ANY_STOP}[\s\u00a0\u202f]{{0,2}}[”“»›」』’\")）])(?!{_ON})(?!\s*+[\p{{IsHan}}\p{{IsHiragana}}])(?![\p{{Lo}}])"
_GREEK_ASK = r"(?<=[\p{IsGreek}\u0300-\u036f]);"
_STOP = rf"(?:{_ANY_STOP}|{_GREEK_ASK})(?:[^\S\n\ue001]?(?:{_ANY_STOP}))*+(?:{_CLOSERS})*+"
# CJK, Indic and Ethiopic stops need no blank after them
_FREE = r"(?<=[。｡।॥።፧፨？！][”’»）)\]」』›]{0,3})(?!\s*+[,:،、，)\]])"
_FINAL = rf"{_STOP}(?:{_END}|{_FREE})"
_PLAIN = rf"[^{_STOPS}{_OPENERS}\ue001\ue002]++"
# most text, in classes that are quick to test
_ASCII = r"[a-zA-Z ,\n]++"
_COMMON = (
    r"[a-zA-Z0-9 ,\n\u00a0\u00c0-\u037d\u037f-\u055f\u0561-\u0588\u05d0-\u060a\u060d-\u061a\u0620-\u06d3"
    r"\u06d5-\u0963\u0966-\u1361\u1369-\u2017\u3040-\u9fff\uac00-\ud7a3\ue000]++"
)
_LOOP = (
    rf"(?:{_ASCII}|{_COMMON}|{_PLAIN}"
    rf"|{_QUOTE}(?!{_QUOTE_ENDS})"
    rf"|(?!{_QUOTE})[{_OPENERS}]"
    rf"|(?!{_FINAL}){_STOP}"
    rf"|(?!{_GREEK_ASK});)"
)
_UNIT = rf"(?:{_LOOP}{{1,800}}+(?:{_FINAL}|{_QUOTE})?+|{_FINAL}|{_QUOTE}|[\ue001\ue002]|[\s\S])"


def masked(text: Column) -> Column:
    """``text`` with marks that end nothing replaced one for one."""
    # placeholders that the text itself holds would be taken for masks
    out = F.translate(text, _DOT + _HARD + _SOFT, "￼￼￼")
    for pattern, mark in _MASKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def pieces(text: Column) -> Column:
    """The pieces that tile ``text``, still masked: units and the marks between them."""
    return F.regexp_extract_all(masked(text), F.lit(_UNIT), F.lit(0))


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, sent_no, sent_start, sent_end``: the units of every text in order, ends exclusive, blanks around them not.

    Defined results: null, empty and blank texts have no units; of rows repeated under an id one counts; a quotation or
    parenthesis without its partner within 5,000 characters protects nothing; other columns are ignored.
    The shuffle carries lengths, not text; one document's pieces are put in order in one task.
    """
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    cut = src.select("id", F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))
    blanks = F.lit(_BLANKS)
    sized = cut.select(
        "id",
        "pos",
        F.length("piece").alias("n"),
        (F.length("piece") - F.length(F.ltrim("piece", blanks))).alias("lead"),
        F.length(F.rtrim("piece", blanks)).alias("last"),
    )
    # one exchange serves the repeated rows and the window
    sized = sized.repartition("id").dropDuplicates(["id", "pos"])
    w = Window.partitionBy("id").orderBy("pos")
    placed = sized.withColumn("end", F.sum("n").over(w)).where("last > lead")
    start = F.col("end") - F.col("n")
    return placed.select(
        F.col("id").alias(id_col),
        F.row_number().over(w).alias("sent_no"),
        (start + F.col("lead")).cast("int").alias("sent_start"),
        (start + F.col("last")).cast("int").alias("sent_end"),
    )


def with_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` joined to its units, with their restored text in ``sentence``."""
    units = split_sentences(df, id_col, text_col)
    return df.join(units, id_col).withColumn("sentence", F.substring(F.col(f"`{text_col}`"), F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start")))
