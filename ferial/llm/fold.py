"""What a reader sees of a character: one table for look-alikes, ignorables, widths, ligatures and blanks."""

from __future__ import annotations

import unicodedata
from functools import cache

# Letters whose shape is that of a Latin letter, by script, each line letters then shapes.
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХҮӀԌԚԜ", "ABESIJKMHOPCTYXYIGQW"),  # Cyrillic capitals
    ("аеѕіјорсухһԁԛԝӏѵ", "aesijopcyxhdqwlv"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("αγιονρυϲϳ", "ayiovpucj"),  # Greek small letters
    ("ՍՏԼՕհոսօյ", "USLOhnuoj"),  # Armenian
    ("ɡɑ", "ga"),  # Latin variants
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ"),  # Cherokee
    ("ⲞⲢⲤⲔⲎⲒⲘⲚⲦⲟⲥ", "OPCKHIMNToc"),  # Coptic
    ("‐‑", "--"),  # hyphens
)
# Compatibility tags that keep the look, and ranges where a plain <compat> does.
_TAGS = {"<wide>", "<narrow>", "<small>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_COMPAT = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x587, 0x587), (0x2E80, 0x2FDF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
_IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)
_BREAKS = "\x85\u2028\u2029"
_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC")


def _expand(ch: str) -> str:
    """The look-keeping compatibility expansion of one character, decomposed."""
    d = unicodedata.decomposition(ch).split()
    if not d:
        return ch
    if d[0][0] == "<":
        if d[0] not in _TAGS and not (d[0] == "<compat>" and any(a <= ord(ch) <= b for a, b in _COMPAT)):
            return ch
        d = d[1:]
    return "".join(_expand(chr(int(x, 16))) for x in d)


@cache
def fold_table() -> dict[int, str]:
    """For ``str.translate``: every character whose look is stored under another form."""
    shape = {a: b for letters, shapes in LOOKALIKES for a, b in zip(letters, shapes)}
    out: dict[int, str] = {}
    for cp in range(0x30000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or cp < 128:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Zs":
            seen = " "
        else:
            seen = "".join(shape.get(c, c) for c in _expand(ch))
            if any(unicodedata.category(c) == "Zs" for c in seen):
                continue
        if seen != ch:
            out[cp] = seen
    for a, b in _IGNORABLE:
        out.update(dict.fromkeys(range(a, b + 1), ""))
    out.update({ord(c): "\n" for c in _BREAKS})
    out[9] = " "
    return out


def look(text: str) -> str:
    """The decomposed look of a text: equal for texts that a reader cannot tell apart."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\t", " ")
    seen = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(fold_table())
    return unicodedata.normalize("NFD", seen)


@cache
def _script(ch: str) -> str:
    word = unicodedata.name(ch, "").split(" ", 1)[0]
    return word if word in _SCRIPTS else ""


@cache
def _plain() -> frozenset[int]:
    """Characters that occur in naturally spelled words although their look is that of another letter."""
    return frozenset(ord(c) for letters, _ in LOOKALIKES[:5] for c in letters)


def natural(token: str) -> bool:
    """Is this the ordinary spelling of something: composed, of one script, without ignorables or compatibility forms?"""
    if token.isascii():
        return True
    if unicodedata.normalize("NFC", token) != token:
        return False
    table, plain = fold_table(), _plain()
    scripts = set()
    for ch in unicodedata.normalize("NFD", token):
        if ord(ch) in table and ord(ch) not in plain:
            return False
        if ch.isalpha() and (s := _script(ch)):
            scripts.add(s)
    return len(scripts) <= 1


@cache
def spellings() -> dict[str, tuple[str, ...]]:
    """For every shape the letters of natural words that may show it, the shape itself first."""
    out: dict[str, list[str]] = {}
    for letters, shapes in LOOKALIKES[:5]:
        for a, b in zip(letters, shapes):
            out.setdefault(b, [b]).append(a)
    return {k: tuple(v) for k, v in out.items()}
