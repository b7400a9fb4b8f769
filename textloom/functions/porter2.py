"""The Porter2 ("Snowball English") stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDS = "cdeghkmnrt"
REGION_PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_LONG_FIRST = {name: sorted(table, key=len, reverse=True) for name, table in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}


def _after(word: str, start: int) -> int:
    found = _REGION.match(word, start)
    return found.end() if found else len(word)


def _has_vowel(text: str) -> bool:
    return any(c in VOWELS for c in text)


def _ends_short(word: str) -> bool:
    """Whether it ends in a short syllable; Y is a consonant here."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _ending(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word, lower-cased first."""
    word = word.lower()
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word)
    prefix = next((p for p in REGION_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(word, 0)
    r2 = _after(word, r1)

    # 0 and 1a
    if e := _ending(word, ("'s'", "'s", "'")):
        word = word[: -len(e)]
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_1A:
        return word

    # 1b
    if e := _ending(word, ("eedly", "eed")):
        if len(word) - len(e) >= r1:
            word = word[: -len(e)] + "ee"
    elif (e := _ending(word, ("ingly", "edly", "ing", "ed"))) and _has_vowel(word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _ends_short(word):
            word += "e"

    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    # 2
    if (e := _ending(word, _LONG_FIRST["2"])) and len(word) - len(e) >= r1:
        rest = word[: -len(e)]
        if e == "ogi":
            word = rest + "og" if rest.endswith("l") else word
        elif e == "li":
            word = rest if rest[-1:] and rest[-1] in LI_ENDS else word
        else:
            word = rest + STEP_2[e]
    # 3
    if (e := _ending(word, _LONG_FIRST["3"])) and len(word) - len(e) >= r1 and (e != "ative" or len(word) - len(e) >= r2):
        word = word[: -len(e)] + STEP_3[e]
    # 4
    if (e := _ending(word, _LONG_FIRST["4"])) and len(word) - len(e) >= r2 and (e != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(e)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    """For distinct words only: one call a word of the vocabulary, not one a token."""
    return words.map(stem, na_action="ignore")
