"""Stems of English (Porter 1980) and Russian (Snowball) words, over distinct words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import split_words

# English words that carry no content.
STOPWORDS = frozenset("a an and are as at be been being but by can could did do does for from had has have he her his how i if in into is it its may me might more most my no nor not of off on or our out over own same she should so some such than that the their them then there these they this those through to too under up very was we were what when where which while who why will with would you your".split())

_VOWELS = "aeiou"


def _is_consonant(word: str, i: int) -> bool:
    if word[i] in _VOWELS:
        return False
    return i == 0 or word[i] != "y" or not _is_consonant(word, i - 1)


def _shape(word: str) -> str:
    return "".join("c" if _is_consonant(word, i) else "v" for i in range(len(word)))


def measure(word: str) -> int:
    """Porter's m: how often vowels are followed by consonants."""
    return len(re.findall(r"v+c+", _shape(word)))


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _is_consonant(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


# Suffixes of steps 2, 3 and 4 as published.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(word: str, suffixes: list[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = _longest(word, ["ed", "ing"])
        if cut and "v" in _shape(word[: -len(cut)]):
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and _short(word)):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        cut = _longest(word, list(table))
        if cut and measure(word[: -len(cut)]) > 0:
            word = word[: -len(cut)] + table[cut]
    cut = _longest(word, list(_STEP4))
    if cut:
        rest = word[: -len(cut)]
        if measure(rest) > 1 and (cut != "ion" or rest.endswith(("s", "t"))):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


# Russian suffix groups as published for Snowball; those that need а or я before them are listed apart.
_RU_VOWELS = "аеиоуыэюя"
_GERUND_AFTER_A = (
    "в", "вши", "вшись",
)
_GERUND = (
    "ив", "ивши", "ившись", "ыв", "ывши", "ывшись",
)
_ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
_PARTICIPLE_AFTER_A = (
    "ем", "нн", "вш", "ющ", "щ",
)
_PARTICIPLE = (
    "ивш", "ывш", "ующ",
)
_REFLEXIVE = (
    "ся", "сь",
)
_VERB_AFTER_A = (
    "ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно",
)
_VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью",
    "ю", "ия", "ья", "я",
)
#: What a step leaves has at least so many letters; else the step doesn't count.
LEAST_LEFT = 3


def _without(word: str, region: int, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str:
    """The word without its longest suffix that lies in the region; some must have а or я before them, wherever that stands."""
    fits = [s for s in free if word.endswith(s)] + [s for s in after_a if word.endswith(s) and word[: -len(s)].endswith(("а", "я"))]
    cut = max((s for s in fits if len(word) - len(s) >= region), key=len, default="")
    left = word[: len(word) - len(cut)]
    return left if len(left) >= LEAST_LEFT else word


def snowball_ru(word: str) -> str:
    """A word of no vowel stays; nor does any step leave less than LEAST_LEFT letters."""
    word = word.replace("ё", "е")
    m = re.search(f"[{_RU_VOWELS}]", word)
    if not m:
        return word
    region = m.end()
    closed = re.compile(f"[{_RU_VOWELS}][^{_RU_VOWELS}]")
    one = closed.search(word)
    two = closed.search(word, one.end()) if one else None
    late = two.end() if two else len(word)
    out = _without(word, region, _GERUND, _GERUND_AFTER_A)
    if out == word:
        out = _without(word, region, _REFLEXIVE)
        plain = _without(out, region, _ADJECTIVE)
        if plain != out:
            out = _without(plain, region, _PARTICIPLE, _PARTICIPLE_AFTER_A)
        else:
            plain = _without(out, region, _VERB, _VERB_AFTER_A)
            out = plain if plain != out else _without(out, region, _NOUN)
    out = _without(out, region, ("и",))
    out = _without(out, max(region, late), ("ост", "ость"))
    shorter = _without(out, region, ("ейш", "ейше"))
    if shorter.endswith("нн") and len(shorter) - 1 >= region:
        return _without(shorter, region, ("н",))
    return _without(shorter, region, ("ь",)) if shorter == out else shorter


def stem(word: str) -> str:
    return snowball_ru(word) if re.search("[Ѐ-ӿ]", word) else porter(word)


@F.pandas_udf(StringType())
def stem_word(words: pd.Series) -> pd.Series:
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


def stem_phrase(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``stems``: ordered stems of a column's content words.  Each distinct word is stemmed once."""
    stop = F.array(*[F.lit(w) for w in sorted(STOPWORDS)])
    split = rows.withColumn("_words", F.filter(split_words(F.col(column)), lambda w: ~F.array_contains(stop, w)))
    words = split.select(F.explode("_words").alias("w")).distinct().withColumn("s", stem_word("w"))
    keyed = split.select(column, "_words").distinct()
    exploded = keyed.select(column, F.posexplode("_words").alias("i", "w")).join(words, "w")
    stems = exploded.groupBy(column).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("stems"))
    return rows.join(stems, column, "left").withColumn("stems", F.coalesce("stems", F.array().cast("array<string>")))


def stem_labels(labels: DataFrame) -> DataFrame:
    return stem_phrase(labels, "label")
