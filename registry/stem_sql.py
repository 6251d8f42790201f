"""Porter's algorithm as a chain of SQL steps over a table of distinct tokens.

``s`` is the shape of the word ``w``: c and v per letter. A prefix of the word has the
prefix of its shape, so a stem's measure is the number of vc in that prefix.
"""

from __future__ import annotations

from corrspark.functions import words as W
from registry import sql_text as S


def _shape(w: str) -> str:
    plain = f"regexp_replace(regexp_replace({w}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    plain = f"regexp_replace({plain}, '^y', 'c')"
    for _ in range(3):  # y is a vowel after a consonant; runs of up to six y
        plain = f"replace(replace({plain}, 'cy', 'cv'), 'vy', 'vc')"
    return plain


def _m(n: str) -> str:
    """Measure of the first n letters."""
    return f"((length(left(s, {n})) - length(replace(left(s, {n}), 'vc', ''))) // 2)"


def _short(w: str, s: str) -> str:
    return f"(CASE WHEN length({w}) = 2 THEN {s} = 'vc' ELSE ends_with({s}, 'cvc') AND right({w}, 1) NOT IN ('w', 'x', 'y') END)"


def _swap(table, least: int = 0) -> str:
    cases = []
    for rules in table.values():
        for suffix, new in rules:
            n = f"length(w) - {len(suffix)}"
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_m(n)} > {least} THEN left(w, {n}) || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _drop() -> str:
    cases = []
    for rules in W.STEP4.values():
        for suffix in rules:
            n = f"length(w) - {len(suffix)}"
            also = f" AND right(left(w, {n}), 1) IN ('s', 't')" if suffix == "ion" else ""
            cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_m(n)} > 1{also} THEN left(w, {n}) ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


_PLURAL = """CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
  WHEN ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"""
#: The word before its past ending, marked, or the word as it stays.
_PAST = f"""CASE WHEN ends_with(w, 'ied') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
  WHEN ends_with(w, 'eed') THEN CASE WHEN {_m('length(w) - 3')} > 0 THEN left(w, length(w) - 1) ELSE w END
  WHEN ends_with(w, 'ed') AND contains(left(s, length(w) - 2), 'v') THEN left(w, length(w) - 2) || ' '
  WHEN ends_with(w, 'ing') AND contains(left(s, length(w) - 3), 'v') THEN left(w, length(w) - 3) || ' ' ELSE w END"""
_b, _bs = "rtrim(w, ' ')", "left(s, length(w) - 1)"
_MEND = f"""CASE WHEN NOT ends_with(w, ' ') THEN w
  WHEN right({_b}, 2) IN ('at', 'bl', 'iz') THEN {_b} || 'e'
  WHEN length({_b}) > 1 AND right({_b}, 1) = left(right({_b}, 2), 1) AND right({_bs}, 1) = 'c'
    THEN CASE WHEN right({_b}, 1) IN ('l', 's', 'z') THEN {_b} ELSE left({_b}, length({_b}) - 1) END
  WHEN {_m('length(w) - 1')} = 1 AND {_short(_b, _bs)} THEN {_b} || 'e' ELSE {_b} END"""
_Y = "CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND left(right(s, 2), 1) = 'c' THEN left(w, length(w) - 1) || 'i' ELSE w END"
_LOGI = f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {_m('length(w) - 3')} > 0 THEN left(w, length(w) - 1) ELSE w END ELSE {_swap(W.STEP2)} END"
_n = "length(w) - 1"
_E = f"""CASE WHEN ends_with(w, 'e') AND ({_m(_n)} > 1 OR ({_m(_n)} = 1 AND NOT {_short(f'left(w, {_n})', f'left(s, {_n})')})) THEN left(w, {_n}) ELSE w END"""
_LL = f"CASE WHEN ends_with(w, 'll') AND {_m(_n)} > 1 THEN left(w, {_n}) ELSE w END"
_IRREGULAR = " ".join(f"WHEN {S.quote(a)} THEN {S.quote(b)}" for a, b in W.IRREGULAR_STEMS.items())


def stems(source: str, name: str = "stems") -> str:
    """CTEs that end in ``name(t, stem)`` for the column ``t`` of the table ``source``."""
    steps = [_PLURAL, _PAST, _MEND, _Y, _LOGI, _swap(W.STEP3), _drop(), _E, _LL]
    out = [f"{name}_0 AS (SELECT DISTINCT t, lower(t) AS w FROM {source})"]
    for i, step in enumerate(steps):
        out.append(f"{name}_{i + 1} AS (SELECT t, {step} AS w FROM (SELECT t, w, {_shape('w')} AS s FROM {name}_{i}))")
    out.append(f"""{name} AS (SELECT t, CASE lower(t) {_IRREGULAR} ELSE CASE WHEN length(t) <= 2 THEN lower(t) ELSE w END END AS stem FROM {name}_{len(steps)})""")
    return ",\n".join(out)
