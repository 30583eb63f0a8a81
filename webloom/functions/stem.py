"""The English stemmer of the full-text index, as built-in column functions.

This is the published English ("Porter2") suffix-stripping algorithm as one
column expression, so it stays in the JVM.  Each step is bound to a variable:
chained projections would be substituted into each other when a filter on the
stem is pushed down, and grow without bound.  Endings are compared as bytes
where that will do, which is several times faster than a regular expression.
Words with a digit are left alone, as the index does not treat them as English.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

# -- fixed values of the published algorithm ---------------------------------
VOWEL = "[aeiouy]"
NON_VOWEL = "[^aeiouy]"
REGION_1 = "^(gener|commun|arsen|.*?[aeiouy][^aeiouy])"
REGION_2 = "^.*?[aeiouy][^aeiouy]"
SHORT_END = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
SPECIAL_WORDS = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
DONE_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
STEP_3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
# ---------------------------------------------------------------------------


def _ends(word: Column, endings) -> Column:
    """Whether ``word`` ends with one of ``endings``."""
    hit = F.lit(False)
    for ending in endings:
        hit = hit | word.endswith(ending)
    return hit


def _longest(word: Column, suffixes) -> Column:
    """The longest of ``suffixes`` that ``word`` ends with, or an empty text.

    The last letter is looked at first, so most suffixes are never compared.
    """
    found = F
    for last in sorted({s[-1] for s in suffixes}):
        same = F
        for suffix in sorted((s for s in suffixes if s[-1] == last), key=lambda s: (-len(s), s)):
            same = same.when(word.endswith(suffix), F.lit(suffix))
        found = found.when(word.endswith(last), same.otherwise(F.lit("")))
    return found.otherwise(F.lit(""))


def _table(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _cut(word: Column, n: Column | int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _region(pattern: str, text: Column) -> Column:
    """Length of what ``pattern`` matches at the start, of the whole text if nothing."""
    return F.length(F.regexp_extract(text, f"{pattern}|^.*", 0))


def _by_suffix(word: Column, suffixes, body) -> Column:
    """``body(suffix, rest)`` for the longest of ``suffixes``, else the word."""

    def split(suf: Column) -> Column:
        return F.when(suf == "", word).otherwise(
            let(_cut(word, F.length(suf)), lambda rest: F.coalesce(body(suf, rest), word))
        )

    return let(_longest(word, suffixes), split)


def _plural(w: Column, r1: Column, r2: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2))
        .when(_ends(w, ("ied", "ies")), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when(~w.endswith("s") | _ends(w, ("us", "ss")), w)
        .when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1))
        .otherwise(w)
    )


def _participle(w: Column, r1: Column, r2: Column) -> Column:
    def strip(suf: Column, rest: Column) -> Column:
        repaired = (
            F.when(_ends(rest, ("at", "bl", "iz")), F.concat(rest, F.lit("e")))
            .when(_ends(rest, DOUBLES), _cut(rest, 1))
            .when((r1 >= F.length(rest)) & rest.rlike(SHORT_END), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )
        return F.when(
            suf.startswith("ee"), F.when(F.length(rest) >= r1, F.concat(rest, F.lit("ee")))
        ).when(rest.rlike(VOWEL), repaired)

    return _by_suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"), strip)


def _final_y(w: Column, r1: Column, r2: Column) -> Column:
    return F.when(_ends(w, "yY") & w.rlike(f"^.+{NON_VOWEL}[yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_2(w: Column, r1: Column, r2: Column) -> Column:
    def swap(suf: Column, rest: Column) -> Column:
        allowed = (
            (F.length(rest) >= r1)
            & ((suf != "ogi") | rest.endswith("l"))
            & ((suf != "li") | _ends(rest, LI_BEFORE))
        )
        return F.when(allowed, F.concat(rest, _table(STEP_2)[suf]))

    return _by_suffix(w, STEP_2, swap)


def _step_3(w: Column, r1: Column, r2: Column) -> Column:
    def swap(suf: Column, rest: Column) -> Column:
        allowed = (F.length(rest) >= r1) & ((suf != "ative") | (F.length(rest) >= r2))
        return F.when(allowed, F.concat(rest, _table(STEP_3)[suf]))

    return _by_suffix(w, STEP_3, swap)


def _step_4(w: Column, r1: Column, r2: Column) -> Column:
    def drop(suf: Column, rest: Column) -> Column:
        return F.when((F.length(rest) >= r2) & ((suf != "ion") | _ends(rest, "st")), rest)

    return _by_suffix(w, STEP_4, drop)


def _final_letter(w: Column, r1: Column, r2: Column) -> Column:
    before = F.length(w) - 1
    return (
        F.when(
            w.endswith("e") & ((before >= r2) | ((before >= r1) & ~_cut(w, 1).rlike(SHORT_END))), _cut(w, 1)
        )
        .when(w.endswith("ll") & (before >= r2), _cut(w, 1))
        .otherwise(w)
    )


def _run(steps, w: Column, r1: Column, r2: Column) -> Column:
    """Apply the steps in order, each on the bound result of the one before."""
    if not steps:
        return w
    return let(steps[0](w, r1, r2), lambda v: _run(steps[1:], v, r1, r2))


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    rest = (_participle, _final_y, _step_2, _step_3, _step_4, _final_letter)

    def regular(w: Column) -> Column:
        def with_regions(r1: Column, r2: Column) -> Column:
            return let(
                _plural(w, r1, r2),
                lambda v: F.when(v.isin(*DONE_AFTER_PLURAL), v).otherwise(_run(rest, v, r1, r2)),
            )

        return let(
            _region(REGION_1, w),
            lambda r1: let(
                r1 + _region(REGION_2, F.substr(w, r1 + 1)), lambda r2: with_regions(r1, r2)
            ),
        )

    marked = F.when(
        word.contains("y"), F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")
    ).otherwise(word)
    return (
        F.when((F.length(word) <= 2) | word.rlike(r"\p{N}"), word)
        .when(word.isin(*SPECIAL_WORDS), _table(SPECIAL_WORDS)[word])
        .otherwise(F.translate(let(marked, regular), "Y", "y"))
    )
