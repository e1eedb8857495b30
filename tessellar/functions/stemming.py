"""English stems by Porter's published rules (1980), and folding by Unicode decomposition.

A rule list is tried in the order of its endings, longest first: the first ending that fits decides, whether or not its
condition on the stem holds. Stems are made once for each distinct word and joined back to the rows that hold it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The endings of the published rules and what replaces them, where the measure of the stem is over 0.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# The endings that go where the measure of the stem is over 1; ion only after s or t.
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _pattern(word: str) -> str:
    """A word's letters as v or c: y is a vowel after a consonant."""
    out = []
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _pattern(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _pattern(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c"


def _replaced(word: str, rules: dict[str, str]) -> str:
    ending = next((e for e in sorted(rules, key=len, reverse=True) if word.endswith(e)), None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    return stem + rules[ending] if _measure(stem) > 0 else word


def _plural(word: str) -> str:
    for ending, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            return word[: -len(ending)] + to
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e)), None)
    if ending is None or "v" not in _pattern(word[: -len(ending)]):
        return word
    word = word[: -len(ending)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _short_end(word) else word


def _without(word: str) -> str:
    ending = next((e for e in sorted(STEP_4, key=len, reverse=True) if word.endswith(e)), None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    return stem if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))) else word


def _last(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem of a lower-cased word; words of up to two letters, and those with other signs than a to z, stay."""
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    return _last(_without(_replaced(_replaced(word, STEP_2), STEP_3)))


def fold(text: str) -> str:
    """Lower case without diacritics: decomposed letters lose their marks; letters that have no decomposition stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def run(words: pd.Series) -> pd.Series:
        distinct = {w: f(w) for w in words.dropna().unique()}
        return words.map(distinct)

    return lambda c: run(c)


#: Of columns of words: each distinct word of a batch is handled once. Use them on a vocabulary, not on all tokens.
stems, folds = _each(stem), _each(fold)
