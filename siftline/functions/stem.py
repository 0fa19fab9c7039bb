"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), for distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = dict((x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """c for consonants, v for vowels; y after a consonant is a vowel."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c+", shape(word)))


def ends_cvc(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if measure(base) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not ends_cvc(base):
            word = base
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stemmed(term: str | Column) -> Column:
    return F.pandas_udf(_stemmed, "string")(term)


def _stemmed(terms: pd.Series) -> pd.Series:
    return terms.map(stem)
