"""One plain form for characters that look like ordinary ones.

The tables follow from rules over Python's Unicode database, but for the look-alike letters, which
are fixed values.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter (Cyrillic, then Greek, then others).
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ӕ": "æ",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ӕ": "Æ", "Ԛ": "Q", "Ӏ": "I",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ʏ": "Y", "ᴏ": "o", "ⅼ": "l", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꭲ": "T",
}

# Dashes that stand for the hyphen in an identifier.
DASHES = "‐‑‒–—―−﹘﹣－⁃˗"

# Compatibility tags of width and presentation variants; superscripts, subscripts and fractions are ordinary signs.
VARIANT_TAGS = ("<wide>", "<narrow>", "<font>", "<small>", "<circle>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")


_LATIN = re.compile(r"[0-9A-Za-z\u00C0-\u024F().]+").fullmatch


@lru_cache(maxsize=1)
def variants() -> dict[str, str]:
    """Width and presentation variants of letters, digits and signs with their ordinary form.

    By rule: a compatibility mapping under one of VARIANT_TAGS, a ligature of letters, any other compatibility
    form of a letter or number that is made of Latin letters, digits, brackets and full stops (Roman numerals,
    letter pairs, bracketed digits), or a canonical singleton.
    """
    found = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if not d or 0xAC00 <= cp <= 0xD7A3:
            continue
        tag, _, rest = d.partition(" ") if d[0] == "<" else ("", "", d)
        to = unicodedata.normalize("NFKC", ch)
        ligature = tag == "<compat>" and (0xFB00 <= cp <= 0xFB4F or (unicodedata.category(ch)[0] in "LN" and _LATIN(to) is not None))
        singleton = not tag and " " not in rest
        if to != ch and " " not in to and (tag in VARIANT_TAGS or ligature or singleton) and not unicodedata.category(ch).startswith("Z"):
            found[ch] = to
    return found


@lru_cache(maxsize=1)
def ignorable() -> str:
    """Characters that are not seen: format characters, variation selectors, fillers."""
    out = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"]
    out += [chr(c) for c in (*range(0xFE00, 0xFE10), *range(0x180B, 0x180E), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xE0100, 0xE01F0))]
    return "".join(dict.fromkeys(out))


@lru_cache(maxsize=1)
def blanks() -> str:
    """Blanks other than U+0020 and than line ends and tabs."""
    return "".join(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")


@lru_cache(maxsize=1)
def identifier_table() -> tuple[str, str]:
    """(from, to) for translate(): one character each, all that an identifier may hide in; then what is deleted."""
    pairs = {k: v for k, v in variants().items() if len(v) == 1 and v.isascii()}
    pairs |= {k: v for k, v in LOOKALIKES.items() if len(v) == 1}
    pairs |= dict.fromkeys(DASHES, "-") | dict.fromkeys(blanks() + "\t\r\n", " ")
    return "".join(pairs) + ignorable(), "".join(pairs.values())


def plain_section_id(value: Column) -> Column:
    """The plain form of a section id, like "§ 8-5" or "§ 8-5a".

    Invisible characters go, width variants, look-alike letters, dashes and blanks become plain; the
    sign § is put in front. A value without a chapter-number pair keeps its plain text without blanks
    at its ends; null, or nothing that is seen, gives null.
    """
    a, b = identifier_table()
    text = F.trim(F.regexp_replace(F.translate(value, a, b), " +", " "))
    number = F.regexp_extract(text, r"^(?:§ ?)*([0-9]{1,2} ?- ?[0-9]{1,2} ?[a-zA-Z]?) ?$", 1)
    return F.when(number != "", F.concat(F.lit("§ "), F.replace(number, F.lit(" "), F.lit("")))).when(text != "", text)
