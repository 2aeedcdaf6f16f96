"""Tokens, titles, lines and snippets as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー"
#: Wider than ``_CJK`` and quick to test: blocks that have any such character.
_MAYBE_CJK = (
    r"[ᄀ-ᇿ⺀-鿿ꥠ-꥿가-퟿豈-﫿︰-﹏＀-￯\x{16FE0}-\x{1B2FF}\x{1F200}-\x{1F2FF}\x{20000}-\x{3FFFF}]"
)
#: The same characters and all others; most are told by their number alone, before their script is looked up.
_IN_CJK = rf"[\x{{1100}}-\x{{10FFFF}}&&[一-龥{_CJK}]]"
_NOT_CJK = rf"[[\x00-\x{{10FF}}][^{_CJK}]]"
#: A run of one script group: its first character is no mark, marks go along.
_CJK_RUN = rf"{_IN_CJK}[{_IN_CJK}\p{{M}}]*"
_RUNS = rf"{_CJK_RUN}|[[\p{{L}}\p{{Nd}}]&&{_NOT_CJK}][[\p{{L}}\p{{Nd}}\p{{M}}]&&{_NOT_CJK}]*"
#: What comes before a new part of an identifier, marks included: between digit and letter, small and
#: capital letter, and before the last capital of an acronym.
_BEFORE_PART = (
    r"\p{Nd}\p{M}*(?=\p{L})"
    r"|(?!\p{M})\p{IsLowercase}\p{M}*(?=[\p{IsUppercase}\p{Nd}])"
    r"|\p{IsUppercase}\p{M}*(?=\p{Nd}|\p{IsUppercase}\p{M}*(?!\p{M})\p{IsLowercase})"
    r"|\p{L}\p{M}*(?=\p{Nd})"
)
_WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}\p{M}]*"
_UNIT = rf"{_IN_CJK}\p{{M}}*"
#: Latin-1 and punctuation: no marks, and letters in short ranges. What parts identifiers and words are there.
_BEYOND_LATIN = r"[^\x00-\xFF\u2010-\u2027]"
_LATIN_PART = r"[0-9](?=[A-Za-zÀ-ÖØ-öø-ÿ])|[a-zß-öø-ÿ](?=[A-ZÀ-ÖØ-Þ0-9])|[A-ZÀ-ÖØ-Þ](?=[0-9]|[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])"
_LATIN_WORD = r"[a-z0-9ß-öø-ÿ]+"
#: Characters outside this set may change under NFKC, alone or behind another one.
_STABLE = (
    r"\x00-\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž"
    r"Α-ΡΣ-Ωα-ωА-я–—‘-„•ぁ-ゖァ-ヺー一-鿿가-힣"
)
#: Quick tests that find more than what isn't in ``_STABLE``: beyond Latin-1 and some punctuation, or one of these.
#: (Java is quick with a range or two, and with single characters of Latin-1, but not with many ranges.)
_BEYOND_STABLE, _LATIN_CHANGING = r"[^\x00-\xFF–-•]", r"[\xA0¨ª¯²³´µ¸¹º¼½¾]|‗"


def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text; Spark has no built-in for it.

    Only texts with a character that may change go to Python; of others a null goes.
    """
    may_change = text.rlike(_BEYOND_STABLE) | text.rlike(_LATIN_CHANGING)
    changing = F.when(may_change & text.rlike(f"[^{_STABLE}]"), text)
    return F.coalesce(F.pandas_udf(_normalized, "string")(changing), text)


def cjk_grams(run: Column) -> Column:
    """All single characters of a run, then all pairs, then all triples; marks stay with their character."""
    units = F.regexp_extract_all(run, F.lit(f"({_UNIT})"), F.lit(1))

    def grams(n: int) -> Column:
        starts = F.when(F.size(units) >= n, F.sequence(F.lit(1), F.size(units) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(units, i, n), ""))

    return F.concat(grams(1), grams(2), grams(3))


def tokens(text: Column) -> Column:
    """Search tokens in order of the text, small letters.

    Most texts have no script without spaces: theirs come from one replacement, which parts
    identifiers, and one extraction. (Sigma is apart, as its small form depends on what follows.)
    """
    runs = F.regexp_extract_all(text, F.lit(f"({_RUNS})"), F.lit(1))

    def parted(some: Column) -> Column:
        return F.regexp_replace(some, f"({_BEFORE_PART})", "$1 ")

    def plain(run: Column) -> Column:
        return F.transform(F.split(parted(run), " "), lambda p: F.lower(p))

    def split(run: Column) -> Column:
        return F.when(run.rlike(f"^[{_CJK}]"), cjk_grams(run)).otherwise(plain(run))

    quick = F.regexp_extract_all(F.lower(parted(text)), F.lit(f"({_WORD})"), F.lit(1))
    latin = F.regexp_extract_all(F.lower(F.regexp_replace(text, f"({_LATIN_PART})", "$1 ")), F.lit(_LATIN_WORD), F.lit(0))
    # these few stand for others in compatibility form
    is_latin = ~(text.rlike(_BEYOND_LATIN) | text.rlike("[ªµº²³¹¼½¾]"))
    return F.when(is_latin, latin).when(text.rlike(f"{_MAYBE_CJK}|Σ"), F.flatten(F.transform(runs, split))).otherwise(quick)


def token_count(text: Column) -> Column:
    """How many tokens ``tokens`` gives, without making n-grams: a run of n > 2 characters has n + n - 1 + n - 2."""
    units = F.length(text) - F.length(F.regexp_replace(text, rf"[{_IN_CJK}&&[^\p{{M}}]]+", ""))
    runs = F.regexp_count(text, F.lit(_CJK_RUN))
    longer = F.regexp_count(text, F.lit(rf"{_UNIT}{_IN_CJK}[{_IN_CJK}\p{{M}}]*"))
    rest = F.regexp_replace(F.regexp_replace(text, _CJK_RUN, " "), f"({_BEFORE_PART})", "$1 ")
    some = 3 * units - 2 * runs - longer + F.regexp_count(rest, F.lit(_WORD))
    return F.when(text.rlike(_MAYBE_CJK), some).otherwise(F.size(tokens(text)))


def gram_count(text: Column, gram: str) -> Column:
    """How often an n-gram of a script without spaces is among the tokens of a text; it may overlap itself."""
    return F.regexp_count(text, F.lit(rf"(?={re.escape(gram)}(?!\p{{M}}))"))


def projection(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def title(text: Column, path: Column) -> Column:
    """The first heading of level one or two, else the file's name without its last extension."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#{1,2}\s+(.+)$", 1))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    return F.when(heading != "", heading).otherwise(stem)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\x0B\x0C\r\u0085  ]", -1)


def numbered(rows: Column, first: Column | int = 1) -> Column:
    """``n: text`` for each line, counted from ``first``."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.transform(rows, lambda x, i: F.concat((i + start).cast("string"), F.lit(": "), x))


def term_score(text: Column, terms: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the terms that a text contains; repeated terms count again."""
    found = [F.when(text.contains(t), F.lit(float(w))).otherwise(F.lit(0.0)) for t, w in terms]
    return sum(found, F.lit(0.0))


def best_line(rows: Column, terms: list[tuple[str, float]]) -> Column:
    """Zero-based first line of the highest score; 0 if no line scores."""
    scored = F.transform(
        rows, lambda x, i: F.struct(term_score(F.lower(x), terms).alias("score"), (-i).alias("back"))
    )
    return -F.array_max(scored)["back"]


def snippet(rows: Column, best: Column, height: int = 3, most: int = 500) -> Column:
    """``height`` lines from the one before the best; cut to ``most`` characters with an ellipsis."""
    shown = F.array_join(F.slice(rows, F.greatest(best, F.lit(1)), height), "\n")
    return F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 3), F.lit("..."))).otherwise(shown)


def non_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"^[\t\n\r ]+|[\t\n\r ]+$", "")) > 0
