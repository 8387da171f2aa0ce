"""Plain re-implementations to hold the operators against."""

import collections
import unicodedata

import regex

LOOK = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅοΑΒΕΖΗΙΚΜΝΟΡΤΥΧνρ", "aeopcyxijshdqwlABEKMHOPCTYXIJSoABEZHIKMNOPTYXvp", strict=True))
DROP = dict.fromkeys(map(ord, "\xad​‌‍⁠﻿"))


def fixed(word):
    if all(c in LOOK or c.isnumeric() or "LATIN" in unicodedata.name(c, "") for c in word):
        return "".join(LOOK.get(c, c) for c in word)
    return word


def clean(text):
    text = unicodedata.normalize("NFKC", text.translate(DROP))
    return regex.sub(r"[\p{L}\p{N}]+", lambda m: fixed(m[0]), text)


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", clean(text).lower()) if text else []


def bag(text):
    return collections.Counter(words(text))


def near(a, b, share=0.7, least=12):
    """a, b: bags."""
    x, y = a.total(), b.total()
    return min(x, y) >= least and (a & b).total() * 1000 >= round(share * 1000) * max(x, y)
