"""The Porter stemmer, applied to a vocabulary rather than to every occurrence."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The suffixes of steps 2 and 3 with their replacements, and those of step 4 (Porter, 1980).
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def _kinds(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a word of small Latin letters; words of one or two stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _kinds(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-1:] == word[-2:-1] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        hit = max((p for p in table if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(word[: -len(hit[0])]) > 0:
            word = word[: -len(hit[0])] + hit[1]
    end = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    stem = word[: len(word) - len(end)]
    if end and _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def stem(word: str) -> str:
    """What stands for a token in an index of stems."""
    return porter(unaccented(word))


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: w if w is None else stem(w))


def stemmed_vocabulary(terms: DataFrame) -> DataFrame:
    """``(term, stem)`` of the distinct terms: a join key for stemmed search."""
    return terms.select("term").distinct().withColumn("stem", F.pandas_udf(_stems, "string")("term"))
