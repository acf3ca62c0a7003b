"""Transliteration to Latin letters."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from polynym.functions.lexicon import Lexicon, Words, as_lexicon
from polynym.functions.script import detect_script

# How each letter is written; the empty string drops it.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "ye", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya", "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "Ye",
    "Ё": "Yo", "Ж": "Zh", "З": "Z", "И": "I", "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T",
    "У": "U", "Ф": "F", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ъ": "", "Ы": "Y", "Ь": "", "Э": "E", "Ю": "Yu", "Я": "Ya",
}
ARABIC = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh",
    "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w",
    "ي": "y", "ى": "a", "ة": "a", "أ": "a", "إ": "i", "آ": "a", "ؤ": "w", "ئ": "y", "ء": "", "ّ": "", "َ": "", "ِ": "", "ُ": "", "ً": "",
    "ٍ": "", "ٌ": "", "ْ": "", "پ": "p", "چ": "ch", "ژ": "zh", "گ": "g",
}
# Readings used where no dictionary of readings is at hand.
FEW_HAN = {
    "弗": "fu", "拉": "la", "基": "ji", "米": "mi", "尔": "er", "普": "pu", "京": "jing", "习": "xi", "近": "jin", "平": "ping", "毛": "mao", "泽": "ze",
    "东": "dong", "邓": "deng", "小": "xiao", "江": "jiang", "民": "min", "胡": "hu", "锦": "jin", "涛": "tao", "李": "li", "克": "ke", "强": "qiang",
    "王": "wang", "张": "zhang", "刘": "liu", "陈": "chen", "杨": "yang", "赵": "zhao", "黄": "huang", "周": "zhou", "吴": "wu", "徐": "xu", "孙": "sun",
    "马": "ma", "朱": "zhu", "林": "lin", "何": "he", "郭": "guo", "罗": "luo", "梁": "liang", "宋": "song", "唐": "tang", "蔡": "cai", "金": "jin",
    "韩": "han",
}
# The letters of a Hangul syllable, in the order of its code point.
INITIALS = (
    "g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h",
)
MEDIALS = (
    "a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i",
)
FINALS = (
    "", "g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k",
    "t", "p", "h",
)
# Hepburn kana, in the order of their code points from U+3041; small kana are marked by a leading x.
KANA = (
    "xa", "a", "xi", "i", "xu", "u", "xe", "e", "xo", "o", "ka", "ga", "ki", "gi", "ku", "gu", "ke", "ge", "ko", "go", "sa", "za", "shi", "ji",
    "su", "zu", "se", "ze", "so", "zo", "ta", "da", "chi", "ji", "xtsu", "tsu", "zu", "te", "de", "to", "do", "na", "ni", "nu", "ne", "no", "ha",
    "ba", "pa", "hi", "bi", "pi", "fu", "bu", "pu", "he", "be", "pe", "ho", "bo", "po", "ma", "mi", "mu", "me", "mo", "xya", "ya", "xyu", "yu",
    "xyo", "yo", "ra", "ri", "ru", "re", "ro", "xwa", "wa", "i", "e", "o", "n", "vu",
)
#: Readings of Japanese words; more can be passed in, or read by ``polynym.functions.lexicon``.
JAPANESE_WORDS = {"安倍": "abe", "晋三": "shinzou", "東京": "toukyou"}
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))


def _by_character(text: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _mapped(text: Column, table: dict[str, str]) -> Column:
    """Every character replaced by the table; one-to-one ones in one pass, the others after it."""
    single = {a: b for a, b in table.items() if len(b) <= 1}
    kept = sorted((a, b) for a, b in single.items() if b)
    gone = sorted(a for a, b in single.items() if not b)
    out = F.translate(text, "".join(a for a, _ in kept) + "".join(gone), "".join(b for _, b in kept))
    for a, b in sorted(table.items()):
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def transliterate_cyrillic(text: Column) -> Column:
    """Russian letters; others pass."""
    return _mapped(text, CYRILLIC)


def transliterate_arabic(text: Column) -> Column:
    """Arabic and four Persian letters; vowel marks go, others pass."""
    return _mapped(text, ARABIC)


def transliterate_hangul(text: Column) -> Column:
    """Each syllable by its parts, with no space between syllables."""
    first, middle, last = (F.array(*map(F.lit, x)) for x in (INITIALS, MEDIALS, FINALS))

    def change(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        parts = F.concat(F.get(first, F.floor(at / 588).cast("int")), F.get(middle, (F.floor(at / 28) % 21).cast("int")), F.get(last, (at % 28).cast("int")))
        return F.when((at >= 0) & (at < 11172), parts).otherwise(c)

    return _by_character(text, change)


@functools.cache
def _icu_readings() -> dict[str, str]:
    return {}


def han_readings(spark: SparkSession) -> dict[str, str]:
    """Toneless Mandarin readings by character, from the transliterator that comes with Spark's JVM.

    Asked for once on the driver; where the JVM can't be reached (Spark Connect)
    the short built-in table is all there is.
    """
    known = _icu_readings()
    if not known:
        known.update(FEW_HAN)
        jvm = getattr(spark, "_jvm", None)
        if jvm is not None:
            chars = [chr(c) for a, b in HAN for c in range(a, b + 1)]
            latin = jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII").transliterate("\n".join(chars)).split("\n")
            known.update({c: r.strip() for c, r in zip(chars, latin, strict=True) if r.strip() and r.strip().isascii()})
    return known


HAN_RUN = re.compile("[㐀-䶿一-鿿]+")


def pinyin(text: str, readings: dict[str, str], words: Lexicon | None = None) -> str:
    """Each run of ideographs as syllables or known phrases with spaces between; all else verbatim."""

    def read(run: str) -> str:
        parts = words.segments(run) if words else [(c, None) for c in run]
        return " ".join(reading if reading is not None else readings.get(part, part) for part, reading in parts)

    return HAN_RUN.sub(lambda m: read(m[0]), text)


def few_han(text: str) -> str:
    """The fallback: the short table, else ``x`` and the code point, with nothing between."""
    return HAN_RUN.sub(lambda m: "".join(FEW_HAN.get(c, f"x{ord(c):04x}") for c in m[0]), text)


def kana(text: str) -> str:
    """Hepburn romanisation of a run of kana."""
    out, double = [], False
    for c in text:
        at = ord(c) - (0x60 if ord(c) >= 0x30A1 and ord(c) <= 0x30F6 else 0) - 0x3041
        if c == "ー":
            out.append(out[-1][-1] if out and out[-1] else "")
            continue
        if not 0 <= at < len(KANA):
            out.append(c)
            continue
        name = KANA[at]
        if name == "xtsu":
            double = True
            continue
        if name in ("xya", "xyu", "xyo") and out and out[-1].endswith("i"):
            head = out.pop()[:-1]
            name = head + (name[2:] if head.endswith(("sh", "ch", "j")) else name[1:])
        elif name[0] == "x":
            name = name[1:]
            if len(name) == 1 and out and out[-1] in ("fu", "vu"):
                out[-1] = out[-1][0]
        if double:
            name, double = ("t" if name.startswith("ch") else name[:1]) + name, False
        out.append(name)
    return "".join(out)


KINDS = re.compile("[ぁ-ゖー]+|[ァ-ヺー]+|[㐀-䶿一-鿿]|[^ぁ-ゖァ-ヺー㐀-䶿一-鿿]+")


def japanese(text: str, words: Lexicon, readings: dict[str, str]) -> str:
    """Known words, runs of kana and the rest as segments with spaces between."""
    out: list[str] = []
    unknown = ""

    def rest() -> None:
        for m in KINDS.finditer(unknown):
            piece = m[0]
            out.append(readings.get(piece, piece) if HAN_RUN.fullmatch(piece) else kana(piece) if "ぁ" <= piece[0] <= "ヺ" or piece[0] == "ー" else piece.strip())

    for part, reading in words.segments(text):
        if reading is None:
            unknown += part
            continue
        rest()
        unknown = ""
        out.append(reading)
    rest()
    return " ".join(x for x in out if x)


HAS_KANA = r"[\x{3040}-\x{30ff}]"


def transliterate_cjk(text: Column, spark: SparkSession, full: bool = True, words: Words = None) -> Column:
    """Chinese by phrases of the lexicon, then by character."""
    readings = han_readings(spark) if full else {}
    lexicon = as_lexicon(words, "zh") if full else None

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda s: pinyin(s, readings, lexicon) if full else few_han(s), na_action="ignore")

    return run(text)


def transliterate_japanese(text: Column, spark: SparkSession, words: Words = None, full: bool = True) -> Column:
    """By known words and kana; without ``full``, as Chinese."""
    if not full:
        return transliterate_cjk(text, spark, False)
    readings, lexicon = han_readings(spark), as_lexicon(words, "ja", JAPANESE_WORDS)

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda s: japanese(s, lexicon, readings), na_action="ignore")

    return run(text)


def transliterate_to_latin(text: Column, lang: Column | None = None, spark: SparkSession | None = None, full: bool = True, words: Words = None) -> Column:
    """To Latin letters by script; Latin, Greek, Devanagari, Hebrew and other texts pass.

    CJK is Japanese if ``lang`` is ``ja`` or kana is present. Only CJK leaves the JVM. Null stays null.
    ``words``: readings of Japanese words (a dict), or a ``LexiconSource`` for both languages.
    """
    spark = spark or SparkSession.active()
    script = detect_script(text)
    is_japanese = text.rlike(HAS_KANA) if lang is None else (F.coalesce(lang, F.lit("")) == "ja") | text.rlike(HAS_KANA)
    cjk = script == "CJK"
    return (
        F.when(cjk & is_japanese, transliterate_japanese(F.when(cjk & is_japanese, text), spark, words, full))
        .when(cjk, transliterate_cjk(F.when(cjk & ~is_japanese, text), spark, full, words))
        .when(script == "Cyrillic", transliterate_cyrillic(text))
        .when(script == "Hangul", transliterate_hangul(text))
        .when(script == "Arabic", transliterate_arabic(text))
        .otherwise(text)
    )
