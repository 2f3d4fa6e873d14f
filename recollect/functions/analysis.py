"""What a text search takes as terms: lower case, marks dropped, runs of letters and digits, and the published suffix stemmer.

Index and queries share one analyser. `stemming_sql` states the same stemmer as SQL, made from the same rules, so
searches can be held to it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_LINED, _LINED_ASCII = regex.compile(r"[\p{L}\p{N}]+|\n"), re.compile(r"[0-9a-z]+|\n")
SHORTEST, LONGEST = 3, 64  # letters of a word that has a stem
MANY_MARKS = 16  # different marks that are dropped one by one

# The suffix rules of the published stemmer, each step's longest suffix first where one ends another.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()

# A vowel is a, e, i, o, u, or y behind a consonant; a first y is written Y, for a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({_C})?{_V}{_C}"  # one vowel run and consonant run, or more
MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
ONE = f"^({_C})?{_V}{_C}({_V})?$"
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant other than w, x, y
_ENDS2, _ENDS3, _ENDS4 = tuple(s for s, _ in STEP2), tuple(s for s, _ in STEP3), tuple(STEP4)
#: How a word ends that any step changes; others are their own stems.
_LAST, _LAST_TWO = frozenset("sey"), frozenset(s[-2:] for s in (*_ENDS2, *_ENDS3, *_ENDS4, "ed", "ing", "ll"))
_some, _more, _one, _vowel, _short = (re.compile(p) for p in (SOME, MORE, ONE, VOWEL, SHORT))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case. Shorter and very long words are their own."""
    if not SHORTEST <= len(word) <= LONGEST or word[-1] not in _LAST and word[-2:] not in _LAST_TWO:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _some.search(w[:-3]) else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and _vowel.search(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and w[-1] not in "aeioulszy":
                w = w[:-1]
            elif _short.search(w):
                w += "e"
    if w.endswith("y") and _vowel.search(w[:-1]):
        w = w[:-1] + "i"
    for ends, rules in ((_ENDS2, STEP2), (_ENDS3, STEP3)):
        for suffix, other in rules if w.endswith(ends) else ():
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                w = base + other if _some.search(base) else w
                break
    for suffix in STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(suffix):
            base = w[: -len(suffix)] + (suffix[0] if suffix in ("sion", "tion") else "")
            w = base if _more.search(base) else w
            break
    if w.endswith("e") and (_more.search(w[:-1]) or _one.search(w[:-1]) and not _short.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _more.search(w):
        w = w[:-1]
    return w.lower() if w[:1] == "Y" else w


@lru_cache(1)
def _marks() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"}


def fold(text: str) -> str:
    """Lower case, without marks."""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFD", text.lower())
    marks = [c for c in {*apart} if unicodedata.category(c) == "Mn"]
    if len(marks) > MANY_MARKS:
        return apart.translate(_marks())
    for c in marks:
        apart = apart.replace(c, "")
    return apart


def plain_tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def stemmed_tokens(text: str) -> list[str]:
    return [*map(stem, _TOKEN.findall(fold(text)))]


#: Analysers by name, as a stored index notes them.
ANALYSERS: dict[str, Callable[[str], list[str]]] = {"plain": plain_tokens, "stemmed": stemmed_tokens}
#: What an analyser does to a text, and what it makes of a word of that.
STEPS: dict[str, tuple[Callable[[str], str], Callable[[str], str]]] = {"plain": (str.lower, str), "stemmed": (fold, stem)}


def lined_words(lines: list[str], analyser: str) -> list[str]:
    """The words of many lines, before they become terms, with "\\n" behind each line's; no line holds one."""
    text = STEPS[analyser][0]("\n".join([*lines, ""]))
    return (_LINED_ASCII if text.isascii() else _LINED).findall(text)


def _suffixes(column: str, rules: list[tuple[str, str]], test: str, keep: int = 0) -> str:
    """SQL that replaces the first suffix that fits, if what is left passes the test; `keep` letters of sion and tion stay."""
    cases = []
    for suffix, other in rules:
        cut = len(suffix) - (keep if suffix in ("sion", "tion") else 0)
        base = f"left({column}, length({column}) - {cut})"
        cases.append(f"WHEN suffix({column}, '{suffix}') THEN CASE WHEN regexp_matches({base}, '{test}') THEN {base} || '{other}' ELSE {column} END")
    return f"CASE {' '.join(cases)} ELSE {column} END"


def stemming_sql(words: str) -> str:
    """Common table expressions over a table `words` of distinct folded words (column `word`); the last, `stems`, has word and term."""
    b1 = "CASE WHEN suffix(w, 'ed') THEN left(w, length(w) - 2) WHEN suffix(w, 'ing') THEN left(w, length(w) - 3) END"
    return f"""st0 AS (SELECT word, CASE WHEN left(word, 1) = 'y' THEN 'Y' || substr(word, 2) ELSE word END AS w FROM {words} WHERE length(word) BETWEEN {SHORTEST} AND {LONGEST}),
    st1 AS (SELECT word, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, length(w) - 2) WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w FROM st0),
    st1b AS (SELECT word, w, suffix(w, 'eed') AS eed, {b1} AS b FROM st1),
    st1c AS (SELECT word, CASE WHEN eed THEN CASE WHEN regexp_matches(left(w, length(w) - 3), '{SOME}') THEN left(w, length(w) - 1) ELSE w END
        WHEN b IS NULL OR NOT regexp_matches(b, '{VOWEL}') THEN w WHEN suffix(b, 'at') OR suffix(b, 'bl') OR suffix(b, 'iz') THEN b || 'e'
        WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND NOT contains('aeioulszy', right(b, 1)) THEN left(b, length(b) - 1) WHEN regexp_matches(b, '{SHORT}') THEN b || 'e' ELSE b END AS w FROM st1b),
    st1d AS (SELECT word, CASE WHEN suffix(w, 'y') AND regexp_matches(left(w, length(w) - 1), '{VOWEL}') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM st1c),
    st2 AS (SELECT word, {_suffixes("w", STEP2, SOME)} AS w FROM st1d), st3 AS (SELECT word, {_suffixes("w", STEP3, SOME)} AS w FROM st2),
    st4 AS (SELECT word, {_suffixes("w", [(s, "") for s in STEP4], MORE, 1)} AS w FROM st3), st4e AS (SELECT word, w, left(w, length(w) - 1) AS b FROM st4),
    st5 AS (SELECT word, CASE WHEN suffix(w, 'e') AND (regexp_matches(b, '{MORE}') OR regexp_matches(b, '{ONE}') AND NOT regexp_matches(b, '{SHORT}')) THEN b ELSE w END AS w FROM st4e),
    st6 AS (SELECT word, CASE WHEN suffix(w, 'll') AND regexp_matches(w, '{MORE}') THEN left(w, length(w) - 1) ELSE w END AS w FROM st5),
    stems AS (SELECT word, CASE WHEN left(w, 1) = 'Y' THEN lower(w) ELSE w END AS term FROM st6 UNION ALL SELECT word, word FROM {words} WHERE length(word) NOT BETWEEN {SHORTEST} AND {LONGEST})"""
