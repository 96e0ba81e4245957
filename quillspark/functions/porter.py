"""Porter's stemmer (1980), applied to distinct terms only and joined back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_MEASURE = re.compile(rf"{_V}+(?:(?!{_V})[a-z])+")
_VOWEL = re.compile(_V)
_DOUBLE = re.compile(r"([^aeioulsz])\1$")
_SHORT = re.compile(r"(?:^|[^aeiou])(?<![aeiou])[aeiouy][^aeiouwxy]$")

# The suffix tables of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _longest(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or with other characters stay as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _VOWEL.search(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _DOUBLE.search(w):
                    w = w[:-1]
                elif _measure(w) == 1 and _SHORT.search(w):
                    w += "e"
                break
    if w.endswith("y") and _VOWEL.search(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for terms in batches:
        yield terms.map(lambda t: None if t is None else stem(t))


def stem_terms(postings: DataFrame) -> DataFrame:
    """``postings`` with ``term`` stemmed; Python sees each distinct term once."""
    stems = postings.select("term").distinct().withColumn("stem", stem_udf("term"))
    return postings.join(stems, "term").withColumn("term", F.col("stem")).drop("stem")
