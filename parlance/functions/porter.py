"""Porter's stemmer for English, as column expressions: its five steps are rules of a suffix, a condition and a new suffix.

A word is [C](VC){m}[V] with C and V runs of consonants and vowels; y is a vowel behind a consonant. Before the steps every
y that is a consonant is written Y, so that classes of characters decide, and m > 0, m = 1 and m > 1 are patterns of the
stem. In each step the longest suffix that fits decides, whether its condition holds or not. The same rules, as SQL, are
in STEPS_SQL. Words of one or two letters, and words with other characters than a-z, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_V, _C = "[aeiouy]", "[^aeiouy]"
SOME = f"^{_C}*{_V}+{_C}"  # m > 0
ONE = f"^{_C}*{_V}+{_C}+{_V}*$"  # m = 1
TWO = f"^{_C}*{_V}+{_C}+{_V}+{_C}"  # m > 1
VOWEL = _V
SHORT = f"{_C}{_V}[^aeiouywxY]$"  # consonant, vowel, consonant other than w, x, y
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"  # a double consonant but l, s and z

# Fixed values of the published algorithm: suffix and what it becomes, the longest of a step that fits counts.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")

#: A rule: suffix, pattern that its stem must have (None: none), what takes the suffix's place.
Rule = tuple[str, str | None, str]
_RULES: dict[str, tuple[Rule, ...]] = {
    "1a": tuple((a, None, b) for a, b in STEP_1A),
    "1c": (("y", VOWEL, "i"), ("Y", VOWEL, "i")),
    "2": tuple((a, SOME, b) for a, b in STEP_2),
    "3": tuple((a, SOME, b) for a, b in STEP_3),
    "4": tuple((a, rf"{TWO}.*[st]$|{TWO[:-len(_C)]}[st]$" if a == "ion" else TWO, "") for a in STEP_4),
}


class _Words:
    """Words as columns."""

    def __init__(self, c: Column):
        self.c = c

    def has(self, pattern: str) -> Column:
        return self.c.rlike(pattern)

    def ends(self, suffix: str) -> Column:
        return F.endswith(self.c, F.lit(suffix))

    def less(self, n: int, more: str = "") -> _Words:
        return _Words(F.concat(F.left(self.c, F.length(self.c) - n), F.lit(more)))


def _step(word: Column, rules: tuple[Rule, ...]) -> Column:
    w, out = _Words(word), None
    for suffix, pattern, new in rules:
        stem = w.less(len(suffix))
        good = F.lit(True) if pattern is None else stem.has(pattern)
        then = F.when(good, w.less(len(suffix), new).c).otherwise(word)
        out = F.when(w.ends(suffix), then) if out is None else out.when(w.ends(suffix), then)
    return out.otherwise(word)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _1b(word: Column) -> Column:
    w = _Words(word)
    cut = F.when(w.ends("eed"), F.when(w.less(3).has(SOME), w.less(1).c).otherwise(word)).when(w.ends("ed") & w.less(2).has(VOWEL), F.concat(w.less(2).c, F.lit("\x00"))).when(w.ends("ing") & w.less(3).has(VOWEL), F.concat(w.less(3).c, F.lit("\x00"))).otherwise(word)

    def mended(x: Column) -> Column:
        s = _Words(x).less(1)
        y = F.when(s.has("(at|bl|iz)$"), s.less(0, "e").c).when(s.has(DOUBLE), s.less(1).c).when(s.has(ONE) & s.has(SHORT), s.less(0, "e").c).otherwise(s.c)
        return F.when(F.endswith(x, F.lit("\x00")), y).otherwise(x)

    return _let(cut, mended)


def _5(word: Column) -> Column:
    w = _Words(word)
    stem = w.less(1)
    no_e = F.when(w.ends("e") & (stem.has(TWO) | (stem.has(ONE) & ~stem.has(SHORT))), stem.c).otherwise(word)
    return _let(no_e, lambda x: F.when(F.endswith(x, F.lit("ll")) & x.rlike(TWO), _Words(x).less(1).c).otherwise(x))


def stem(word: Column) -> Column:
    """The stem of a word in lower case; null stays null."""
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiou])y", "$1Y")
    out = marked
    for step in (lambda x: _step(x, _RULES["1a"]), _1b, lambda x: _step(x, _RULES["1c"]), lambda x: _step(x, _RULES["2"]), lambda x: _step(x, _RULES["3"]), lambda x: _step(x, _RULES["4"]), _5):
        out = _let(out, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), F.lower(out)).otherwise(word)


# -- the same as SQL --------------------------------------------------------------------------------------------------
def _step_sql(name: str, rules: tuple[Rule, ...]) -> str:
    cases = " ".join(f"WHEN ends_with(x, '{a}') THEN {f'CASE WHEN regexp_matches(left(x, -{len(a)}), {chr(39)}{p}{chr(39)}) THEN ' if p else ''}left(x, -{len(a)}) || '{b}'{' ELSE x END' if p else ''}" for a, p, b in rules)
    return f"(CASE {cases} ELSE x END)"


def _steps_sql() -> list[str]:
    has = lambda c, p: f"regexp_matches({c}, '{p}')"
    cut = f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN {has('left(x, -3)', SOME)} THEN left(x, -1) ELSE x END WHEN ends_with(x, 'ed') AND {has('left(x, -2)', VOWEL)} THEN left(x, -2) || '#' WHEN ends_with(x, 'ing') AND {has('left(x, -3)', VOWEL)} THEN left(x, -3) || '#' ELSE x END"
    s = "left(x, -1)"
    mended = f"CASE WHEN NOT ends_with(x, '#') THEN x WHEN {has(s, '(at|bl|iz)$')} THEN {s} || 'e' WHEN {has(s, DOUBLE)} THEN left(x, -2) WHEN {has(s, ONE)} AND {has(s, SHORT)} THEN {s} || 'e' ELSE {s} END"
    no_e = f"CASE WHEN ends_with(x, 'e') AND ({has(s, TWO)} OR ({has(s, ONE)} AND NOT {has(s, SHORT)})) THEN {s} ELSE x END"
    no_l = f"CASE WHEN ends_with(x, 'll') AND {has('x', TWO)} THEN {s} ELSE x END"
    return [_step_sql("1a", _RULES["1a"]), cut, mended, _step_sql("1c", _RULES["1c"]), _step_sql("2", _RULES["2"]), _step_sql("3", _RULES["3"]), _step_sql("4", _RULES["4"]), no_e, no_l]


def stems_sql(words: str) -> str:
    """CTEs up to stemmed (word, stem), over a CTE or table of distinct words (word)."""
    ctes, at = [f"st0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS x FROM {words})"], "st0"
    for i, step in enumerate(_steps_sql(), 1):
        ctes.append(f"st{i} AS (SELECT word, {step} AS x FROM {at})")
        at = f"st{i}"
    return ", ".join([*ctes, f"stemmed AS (SELECT word, CASE WHEN length(word) > 2 AND regexp_matches(word, '^[a-z]+$') THEN lower(x) ELSE word END AS stem FROM {at})"])
