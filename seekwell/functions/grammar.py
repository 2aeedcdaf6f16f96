"""The query language: words, ``"phrases"`` and ``-exclusions``, all required unless excluded."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex

from seekwell.functions.names import EngineError

_CJK_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]")

_UNIT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]\p{M}*")


@dataclass(frozen=True)
class Clause:
    text: str
    phrase: bool = False
    excluded: bool = False


@dataclass(frozen=True)
class Atom:
    """Tokens that must follow each other; ``prefix``: the last only has to begin a word."""

    tokens: tuple[str, ...]
    prefix: bool


def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def word_tokens(text: str) -> list[str]:
    """The tokens of a text, as the index has them."""
    out: list[str] = []
    run: list[str] = []

    def kind(c: str) -> str:
        if _CJK_RUN.match(c):
            return "cjk"
        cat = unicodedata.category(c)
        return "word" if cat[0] == "L" or cat == "Nd" else "mark" if cat[0] == "M" else ""

    def close(state: str) -> None:
        if not run:
            return
        if state == "cjk":
            for n in (1, 2, 3):
                out.extend("".join(run[i : i + n]) for i in range(len(run) - n + 1))
        else:
            out.extend(_identifier_parts(run))
        run.clear()

    state = ""
    for c in normal(text):
        k = kind(c)
        if k == "mark" and state:
            run[-1] += c
            continue
        if k != state or not k or k == "mark":
            close(state)
            state = k if k != "mark" else ""
        if state:
            run.append(c)
    close(state)
    return out


def _identifier_parts(units: list[str]) -> list[str]:
    parts, cur = [], ""
    for i, u in enumerate(units):
        if i:
            a, b = units[i - 1][0], u[0]
            after = units[i + 1][0] if i + 1 < len(units) else ""
            digit = (unicodedata.category(a) == "Nd") != (unicodedata.category(b) == "Nd")
            camel = a.islower() and b.isupper()
            acronym = a.isupper() and b.isupper() and after.islower()
            if digit or camel or acronym:
                parts.append(cur.lower())
                cur = ""
        cur += u
    return [*parts, cur.lower()] if cur else parts


def parse(query: str) -> list[Clause]:
    """Clauses of a query; raises on dangling or doubled signs, broken quotes, and nothing to find."""

    def wrong(why: str) -> EngineError:
        return EngineError("INVALID_REQUEST", f"{why}: {query!r}")

    text, clauses, i = normal(query).strip(), [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        excluded = text[i] == "-"
        i += excluded
        if i >= len(text) or text[i].isspace() or (excluded and text[i] == "-"):
            raise wrong("an exclusion needs a word or phrase")
        if text[i] == '"':
            end = text.find('"', i + 1)
            if end < 0:
                raise wrong("a quote is not closed")
            if end + 1 < len(text) and not text[end + 1].isspace():
                raise wrong("a quote is followed by text")
            word, i, phrase = text[i + 1 : end], end + 1, True
        else:
            end = i
            while end < len(text) and not text[end].isspace():
                end += 1
            word, i, phrase = text[i:end], end, False
            if '"' in word:
                raise wrong("a quote is inside a word")
        if not word_tokens(word):
            raise wrong("a clause has no words")
        clauses.append(Clause(word, phrase, excluded))
    if not clauses:
        raise wrong("the query is empty")
    if all(c.excluded for c in clauses):
        raise wrong("all clauses are excluded")
    return clauses


def atoms(clause: Clause) -> list[Atom]:
    """What must match for a clause, all of it.

    Words match as prefixes each, but a hyphenated word is one phrase with a prefix at its
    end. A phrase with a script without spaces requires its tokens in any place, or none if it
    is excluded; whether they adjoin is checked on the text.
    """
    found = word_tokens(clause.text)
    if clause.phrase:
        if needs_text_check(clause):
            return [] if clause.excluded else [Atom((t,), False) for t in found]
        return [Atom(tuple(found), False)]
    if clause.text.find("-") > 0 and len(found) > 1:
        return [Atom(tuple(found), True)]
    return [Atom((t,), True) for t in found]


def needs_text_check(clause: Clause) -> bool:
    """Whether the text itself must have a phrase: only in scripts without spaces."""
    return clause.phrase and bool(_CJK_RUN.search(normal(clause.text)))


def grams(run: str) -> list[str]:
    """The n-grams of a run, as ``text.cjk_grams`` has them."""
    units = _UNIT.findall(run)
    return ["".join(units[i : i + n]) for n in (1, 2, 3) for i in range(len(units) - n + 1)]


def is_gram(token: str) -> bool:
    """Whether a token is an n-gram of a script without spaces."""
    return bool(_CJK_RUN.match(token))


def text_terms(text: str | None) -> list[str]:
    """Words of a text for choosing lines and chunks; repeated ones stay."""
    return normal(text or "").lower().replace('"', "").replace("-", " ").split()


def plain_terms(query: str | None) -> list[str]:
    """Terms of a query: those of clauses that aren't excluded, or of all of it if it is no query."""
    try:
        words = [c.text for c in parse(query or "") if not c.excluded]
    except EngineError:
        words = [query]
    return [t for w in words for t in text_terms(w)]
