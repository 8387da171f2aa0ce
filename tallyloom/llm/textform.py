"""The consistent form of a text and its words.

``clean`` removes zero-width characters and soft hyphens, applies NFKC and
puts look-alike letters back to Latin; ``words`` are the longest runs of
letters and digits of the lower-cased clean form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash

# Zero-width characters and the soft hyphen.
ZERO_WIDTH = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Cyrillic and Greek letters printed like a Latin one.
LOOK_ALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ρ": "p",
}

WORD = re.compile(r"[^\W_]+")
_DROP = {ord(c): None for c in ZERO_WIDTH}
_LATIN = {ord(a): b for a, b in LOOK_ALIKE.items()}
_SUSPECT = re.compile("[" + "".join(LOOK_ALIKE) + "]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _latin(c: str) -> bool:
    return c in LOOK_ALIKE or unicodedata.name(c, "").startswith(("LATIN ", "MODIFIER LETTER", "FEMININE ORD", "MASCULINE ORD"))


def is_disguised(word: str) -> bool:
    """A look-alike letter in a word whose letters are all Latin or look-alikes."""
    return bool(_SUSPECT.search(word)) and all(_latin(c) for c in word if not c.isnumeric())


def to_latin(word: str) -> str:
    return word.translate(_LATIN) if is_disguised(word) else word


def clean(text: str) -> str:
    if text.isascii():
        return text
    text = text.translate(_DROP)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if _SUSPECT.search(text):
        text = WORD.sub(lambda m: to_latin(m[0]), text)
    return text


def words(text: str | None) -> list[str]:
    """Words of a text; none for null, blank and wordless texts."""
    return WORD.findall(clean(text).lower()) if text else []


def hash_words(unique: Iterable[str], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in unique), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads near values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded_words(texts: Iterable[str | None], slice_chars: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets (one more than texts), a code for each word of all texts in a
    row, and the unique words the codes stand for."""
    index: dict[str, int] = {}
    ends, parts, flat = [0], [np.empty(0, np.int64)], []
    chars = done = 0

    def flush() -> None:
        codes, unique = pd.factorize(np.asarray(flat, dtype=object))
        own = np.fromiter((index.setdefault(w, len(index)) for w in unique), np.int64, len(unique))
        parts.append(own[codes] if len(own) else np.empty(0, np.int64))
        flat.clear()

    for text in texts:
        flat += words(text)
        ends.append(done + len(flat))
        chars += len(text or "")
        if chars >= slice_chars:
            done += len(flat)
            chars = 0
            flush()
    flush()
    return np.asarray(ends, np.int64), np.concatenate(parts), list(index)


def bags(ends: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text as a set of numbers, where the second "the" of a text is
    another element than the first, and two sums over them that are equal for
    equal bags of words. ``hashes``: of the word of each code."""
    n = np.diff(ends)
    key = np.sort((np.repeat(np.arange(len(n)), n) << 32) | codes)
    at = np.arange(len(key))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    repeat = at - np.maximum.accumulate(np.where(new, at, 0))
    values = mix(hashes[key & 0xFFFFFFFF] + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return values, sums(ends, mix(values ^ np.uint64(0x51ED270B))), sums(ends, mix(values ^ np.uint64(0xA0761D64)))


def sums(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of each text's values, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]
