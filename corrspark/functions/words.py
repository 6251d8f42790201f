"""Word-level helpers that have no built-in column expression.

Small per-word functions: Porter stemming (Porter 1980, with the usual
irregular forms), noun lemmas by suffix rule, tokens, indel similarity. They
run inside Arrow batches and are memoised per worker, so each distinct word is
worked out once per Python process whatever its frequency.
"""

from __future__ import annotations

import re
from functools import lru_cache

# words that a Python worker remembers per rule, at most: some 20 MB
CACHE_WORDS = 1 << 16
CACHE_PAIRS = 1 << 18

TOKEN = re.compile(r"\w+(?:[.\-]\w+)*|[^\w\s]")
VOWELS = frozenset("aeiou")


def _by_last(table) -> dict[str, list]:
    """Suffix rules by last letter, in table order: most words try few of them."""
    out: dict[str, list] = {}
    for rule in table:
        suffix = rule if isinstance(rule, str) else rule[0]
        out.setdefault(suffix[-1], []).append(rule)
    return out


# Words the stemmer does not derive by rule.
IRREGULAR_STEMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix tables of the published algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
STEP2, STEP3, STEP4 = _by_last(STEP2), _by_last(STEP3), _by_last(STEP4)


class _Letters(dict):
    """Shape of a letter by its code: any that is no vowel is a consonant."""

    def __missing__(self, code: int) -> str:
        return "c"


_LETTERS = _Letters({ord(v): "v" for v in VOWELS})


def _shape(word: str) -> str:
    """Consonant/vowel shape; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_LETTERS)
    shape = []
    for i, letter in enumerate(word):
        if letter in VOWELS or (letter == "y" and i > 0 and shape[-1] == "c"):
            shape.append("v")
        else:
            shape.append("c")
    return "".join(shape)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and _has_vowel(stem):
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _swap(w: str, table, least: int = 0) -> str:
    for suffix, new in table.get(w[-1:], ()):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if _measure(stem) > least else w
    return w


def _derive(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _derive(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, STEP2)


def _drop(w: str) -> str:
    for suffix in STEP4.get(w[-1:], ()):
        if w.endswith(suffix) and not (suffix == "ent" and w.endswith("ment")):
            stem = w[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else w
    return w


def _final_e(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(CACHE_WORDS)
def stem(word: str) -> str:
    """Porter stem of one token, lower-cased."""
    w = word.lower()
    if w in IRREGULAR_STEMS:
        return IRREGULAR_STEMS[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        w = w[:-1] + "i"
    return _final_e(_drop(_swap(_derive(w), STEP3)))


# Noun plurals that no suffix rule covers.
IRREGULAR_NOUNS = {
    "men": "man", "children": "child", "people": "people", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "indices": "index", "vertices": "vertex",
    "matrices": "matrix", "criteria": "criterion", "analyses": "analysis", "data": "data",
    "phenomena": "phenomenon", "has": "ha", "was": "wa",
}
# Noun suffix rules, first match wins.
NOUN_RULES = (
    ("sses", "ss"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"), ("ves", "f"),
)


@lru_cache(CACHE_WORDS)
def noun_lemma(word: str) -> str:
    """Singular of a noun by suffix rule; anything else is unchanged."""
    if word in IRREGULAR_NOUNS:
        return IRREGULAR_NOUNS[word]
    if len(word) <= 3 or word.endswith(("ss", "us", "is")):
        return word
    for suffix, new in NOUN_RULES:
        if word.endswith(suffix) and len(word) > len(suffix) + 1:
            return word[: -len(suffix)] + new
    return word[:-1] if word.endswith("s") else word


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & places.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(CACHE_PAIRS)
def ratio(a: str, b: str) -> int:
    """Indel similarity 0..100: 100 * 2 * common / total length."""
    total = len(a) + len(b)
    return round(100 * 2 * common_length(a, b) / total) if total else 100


def partial_ratio(a: str, b: str) -> int:
    """Best ratio of the shorter string against any same-length window of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0
    width = len(short)
    return max(ratio(short, long[i : i + width]) for i in range(len(long) - width + 1))
