"""Plain Python versions of the matching and masking of platform names, to compare with."""

from __future__ import annotations

import re
from functools import lru_cache

from corrspark import lexicon
from corrspark.functions import words as W
from corrspark.operators.cpe import DETAIL_FIELDS, PREFIX, URI_FIELDS

CACHED_PATTERNS = 4_096


@lru_cache(CACHED_PATTERNS)
def exact_pattern(term: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(term.lower())}\b", re.IGNORECASE)


@lru_cache(CACHED_PATTERNS)
def partial_patterns(vendor: str, product: str) -> list[re.Pattern]:
    """Near spellings of a product name.

    Without vendor: the product with one word left out. With vendor: its first
    word before the product, and the vendor with up to two words in between.
    """
    gap = r"\s+"
    if vendor:
        name = re.escape(product.lower())
        head, whole = re.escape(vendor.lower().split()[0]), re.escape(vendor.lower())
        shapes = [rf"\b{head}\b{gap}{name}", rf"\b{whole}\b{gap}(?:\w+{gap}){{0,2}}{name}"]
    else:
        parts = [re.escape(w) for w in product.lower().split()]
        shapes = [rf"\b(?:{gap.join(parts[:i] + parts[i + 1:])})\b" for i in range(len(parts))] if len(parts) > 1 else []
    return [re.compile(s, re.IGNORECASE) for s in shapes]


@lru_cache(CACHED_PATTERNS)
def spread_pattern(word: str) -> re.Pattern:
    """A word whose letters may be set apart by blanks."""
    return re.compile(r"\b" + r"\s*".join(map(re.escape, word)) + r"\b", re.IGNORECASE)


def replace_split(text: str, word: str, replacement: str) -> str:
    """Replace a word that blanks break into two or three parts."""
    if len(word) < 2 or " " in word:
        return text
    return spread_pattern(word).sub(lambda m: replacement if len(m.group().split()) in (2, 3) else m.group(), text)


def spans(pattern: re.Pattern, text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), len(m.group())) for m in pattern.finditer(text)]


def fuzzy_words(term: str, text: str, threshold: int = 70) -> list[tuple[str, int, int]]:
    """Words of a text that resemble the term: (word, position, length)."""
    term = term.lower()
    return [
        (m.group(), m.start(), len(m.group()))
        for m in re.finditer(r"\b\w+\b", text)
        if _close(m.group().lower(), term, threshold)
    ]


def _close(word: str, term: str, threshold: int) -> bool:
    # the ratio cannot exceed what the two lengths allow
    short, long = sorted((len(word), len(term)))
    return 200 * short > (threshold - 1) * (short + long) and W.ratio(word, term) > threshold


def fuzzy_spans(term: str, text: str, threshold: int = 70, extra_words: int | None = 1) -> list[tuple[str, int, int]]:
    """Runs of words that resemble the term, up to ``extra_words`` longer than it.

    Every longer run around a match matches as well, so without the bound (None) the
    result grows with the square of the text and says nothing more.
    """
    term = term.lower()
    found = list(re.finditer(r"\w+", text))
    longest = len(found) if extra_words is None else len(term.split()) + extra_words
    out = []
    for i in range(len(found)):
        for j in range(i, min(i + longest, len(found))):
            piece = text[found[i].start() : found[j].end()]
            if W.partial_ratio(piece.lower(), term) > threshold:
                out.append((piece, found[i].start(), len(piece)))
    return out


def _replace_spans(text: str, found: list[tuple[str, int, int]], replacement: str) -> str:
    for _, start, length in sorted(found, key=lambda s: -s[1]):
        text = text[:start] + replacement + text[start + length :]
    return text


def _blocks(uris: list[str]) -> dict[tuple[str, str, str], dict[str, list[str]]]:
    """The URIs of one text, aggregated in order of appearance."""
    out: dict = {}
    for uri in uris:
        parts = uri.split(":")
        if not uri.startswith(PREFIX) or len(parts) < 10:
            continue
        parts += ["*"] * (len(URI_FIELDS) + 2 - len(parts))
        named = dict(zip(URI_FIELDS, parts[2:]))
        entry = out.setdefault((named["part"], named["vendor"], named["product"]), {f: [] for f in DETAIL_FIELDS})
        for f in DETAIL_FIELDS:
            if named[f] not in ("*", "-", *entry[f]):
                entry[f].append(named[f])
    return out


def mask_text(text: str, uris: list[str]) -> str:
    """Product names in one text become the label of their part."""
    entries = _blocks(uris)
    if not entries:
        return text
    text, label = text.lower().strip(), ""
    for (part, vendor, product), details in entries.items():
        label = lexicon.CPE_PARTS.get(part, part)
        vendor, product = (x.replace("_", " ").strip().lower() for x in (vendor, product))
        full = f"{vendor} {product}"
        mask = lambda _, label=label: label
        # plain containment first: most patterns need not be compiled at all
        if full in text:
            text = exact_pattern(full).sub(mask, text)
        if product in text and (vendor.split() or [""])[0] in text:
            for pattern in partial_patterns(vendor, product):
                text = pattern.sub(mask, text)
        text = _replace_spans(text, fuzzy_words(full, text), label)
        if product in text:
            text = exact_pattern(product).sub(mask, text)
        text = _replace_spans(text, fuzzy_words(product, text), label)
        names = product.split()
        if sum(name in text for name in names) >= len(names) - 1:
            for pattern in partial_patterns("", product):
                text = pattern.sub(mask, text)
        text = replace_split(text, vendor, "")
        text = replace_split(text, product, label)
        for target in details["target_sw"]:
            text = text.replace(target.lower(), "software")
        for field in DETAIL_FIELDS:
            for value in details[field] if field != "target_sw" else ():
                if value not in (vendor, product):
                    text = text.replace(value.lower(), "")
        if vendor in text and exact_pattern(vendor).search(text):
            text = " ".join(exact_pattern(vendor).sub("", text).split())
    text = " ".join(text.split())
    repeat, before = re.compile(rf"(?i)(\b{re.escape(label)}\b)[\s,.;:]*\1+"), None
    while label and before != text:
        before, text = text, repeat.sub(r"\1", text)
    return " ".join(text.split())
