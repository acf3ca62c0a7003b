"""Script families, told by the Unicode names of characters."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families in the order in which a character's name is searched for them.
NAMED = (
    ("Hangul", ("HANGUL",)),
    ("Latin", ("LATIN",)),
    ("Cyrillic", ("CYRILLIC",)),
    ("CJK", ("CJK", "KANGXI", "KATAKANA", "HIRAGANA")),
    ("Arabic", ("ARABIC",)),
    ("Devanagari", ("DEVANAGARI",)),
    ("Greek", ("GREEK",)),
    ("Hebrew", ("HEBREW",)),
)
# Which family a text that also has Latin belongs to, the first present.
BEFORE_LATIN = ("Cyrillic", "CJK", "Hangul", "Arabic", "Devanagari", "Greek", "Hebrew")
OTHER = "Other"


@functools.cache
def ranges() -> dict[str, list[tuple[int, int]]]:
    """The code points of each family as ranges, found from the names of all characters."""
    out: dict[str, list[tuple[int, int]]] = {family: [] for family, _ in NAMED}
    for cp in range(sys.maxunicode + 1):
        name = unicodedata.name(chr(cp), "")
        family = next((f for f, words in NAMED if any(w in name for w in words)), None) if name else None
        if family and not chr(cp).isspace():
            found = out[family]
            if found and found[-1][1] == cp - 1:
                found[-1] = (found[-1][0], cp)
            else:
                found.append((cp, cp))
    return out


@functools.cache
def pattern(family: str) -> str:
    """A regular expression class of the family's characters."""
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges()[family]) + "]"


#: Up to here all letters are Latin.
LOW = 0x24F


@functools.cache
def low_latin() -> str:
    """A class of the Latin letters up to ``LOW``."""
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{min(b, LOW):x}}}" for a, b in ranges()["Latin"] if a <= LOW) + "]"


def detect_script(text: Column) -> Column:
    """The script family of a text.

    Beside Latin letters, the first other family of ``BEFORE_LATIN`` present
    wins; otherwise the most frequent, and among equals the one seen first.
    Null, blank and unclassified texts are ``Other``.
    """
    text = F.coalesce(text, F.lit(""))
    # Characters up to LOW are Latin or of no family: one pass takes them out, and the families are told by the few that are left.
    rest = F.regexp_replace(text, rf"[\x00-\x{{{LOW:x}}}]+", "")
    n = {family: F.regexp_count(rest, F.lit(pattern(family))) for family, _ in NAMED}
    ranked = F.array_max(F.array(*(F.struct(n[f].alias("n"), (-F.regexp_instr(rest, F.lit(pattern(f)))).alias("at"), F.lit(f).alias("family")) for f, _ in NAMED)))
    mixed = F.coalesce(*(F.when(n[f] > 0, F.lit(f)) for f in BEFORE_LATIN))
    plain = F.when(ranked["n"] > 0, ranked["family"]).otherwise(OTHER)
    latin = text.rlike(low_latin())
    return F.when(rest == "", F.when(latin, F.lit("Latin")).otherwise(OTHER)).when(latin | (n["Latin"] > 0), F.coalesce(mixed, F.lit("Latin"))).otherwise(plain)


def is_same_script(a: Column, b: Column) -> Column:
    return detect_script(a) == detect_script(b)
