"""Names and titles: normal forms used for matching. Null gives the empty string where stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, spelled out; the JVM's own \s is ASCII only.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_KEPT = rf"[^\p{{L}}\p{{N}}_'\-{SPACE[1:-1]}]"
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def _normal_form(form: str):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda s: unicodedata.normalize(form, s), na_action="ignore")

    return run


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """A Unicode normal form. ASCII is its own, and only the rest leaves the JVM's generated code."""
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, text).otherwise(_normal_form(form)(F.when(~ascii_only, text)))


def strip_diacritics(text: Column) -> Column:
    """Decomposed, without non-spacing marks; the rest stays decomposed."""
    return F.regexp_replace(normalize_unicode(text, "NFD"), r"\p{Mn}", "")


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_for_matching(text: Column) -> Column:
    """NFC, lower case, stripped, runs of space to one, then all but word characters, space, - and ' deleted.

    Deleting comes last, so a deleted symbol may leave a space at the end or two inside. Null is empty.
    """
    lowered = F.lower(normalize_unicode(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(strip_space(lowered), f"{SPACE}+", " "), NOT_KEPT, "")


def strip_disambiguation(title: Column) -> Column:
    """A title without the bracketed remark at its end."""
    return F.regexp_replace(title, rf"{SPACE}*\([^()]*\){SPACE}*$", "")


def swap_last_first(title: Column) -> Column:
    """``Last, First`` to ``First Last``; the part before the comma holds no space."""
    return F.regexp_replace(title, rf"^([^{SPACE[1:-1]}]+),{SPACE}+([^{SPACE[1:-1]}].*)$", "$2 $1")


def normalize_title(title: Column) -> Column:
    return swap_last_first(strip_disambiguation(title))


def id_from_uri(uri: Column) -> Column:
    """What follows the last slash; null is empty."""
    return F.substring_index(F.coalesce(uri, F.lit("")), "/", -1)


def language_pair(a: Column, b: Column) -> Column:
    """``xx-yy`` in order, ``?`` for an unknown language."""
    return F.concat_ws("-", F.array_sort(F.array(F.coalesce(a, F.lit("?")), F.coalesce(b, F.lit("?")))))


def default_id(identifier: Column, idx: Column) -> Column:
    """The id, or the row's index where there is none."""
    return F.coalesce(identifier.cast("string"), idx.cast("string"))
