"""Texts that look alike brought to one form: tries and an edit automaton.

The words that the corpus spells plainly, with their counts, are the
vocabulary. A word written with other characters is run through a trie of the
vocabulary by a weighted edit automaton: look-alike letters, compatibility
forms and ignorable characters cost nothing, an accent more or less costs
``ACCENT``. Spellings up to ``MOST_COST`` are accepted: the cheapest, and of these
the most frequent; words without one are normalised by table. Vocabulary and words meet by their skeleton, in which all
look-alikes are one letter, so that each trie is small and no task holds the
whole vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textform import LOOK_ALIKE, ZERO_WIDTH, clean, hash_words, is_disguised
from tallyloom.storage import materialise, shuffle_width

# Kinds of variants, as bits.
COMPATIBILITY, DECOMPOSED, INVISIBLE, SPACE, LOOK = 1, 2, 4, 8, 16
# Letters and digits that look-alikes stand for in more than one way.
AMBIGUOUS = {"ӏ": "li", "Ӏ": "Il", "Ι": "Il", "І": "Il", "ν": "v", "ο": "o", "о": "o", "О": "O", "Ο": "O"}

#: What an accent more or less costs, and what the readings of a word may cost.
ACCENT, MOST_COST = 1, 1

#: Bytes of looked-up words and their forms that every task gets a copy of.
MOST_FORMS = 32_000_000

_EMOJI = "←-⯿〰〽㊗㊙️\U0001f000-\U0001faff"
_STRAY_JOINER = re.compile(f"(?<![{_EMOJI}])‍|‍(?![{_EMOJI}])")
_DROP = {ord(c): None for c in ZERO_WIDTH if c != "‍"}
_DROP_ALL = {ord(c): None for c in ZERO_WIDTH}
_IGNORED = "".join(ZERO_WIDTH)
_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{_IGNORED}]|[̀-ͯ])*")
_PLAIN = re.compile(r"[^\W_]+")
_SPACES = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs") + "]")
_SAME_SHAPE = str.maketrans("il1|0", "lllIo")


def _drop_invisible(text: str) -> str:
    """Without zero-width characters, but for the joiners inside emoji."""
    text = text.translate(_DROP)
    return _STRAY_JOINER.sub("", text) if "‍" in text else text


def by_table(token: str) -> str:
    return clean(token)


def skeleton(word: str) -> str:
    """The same for all words that may be look-alikes of each other."""
    word = unicodedata.normalize("NFKC", word.translate(_DROP_ALL))
    word = "".join(LOOK_ALIKE.get(c, c) for c in word).lower()
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return word.translate(_SAME_SHAPE)


def _readings(c: str) -> list[tuple[str, int]]:
    """What a character of a token may stand for, with its cost."""
    if c in ZERO_WIDTH:
        return [("", 0)]
    wide = unicodedata.normalize("NFKC", c)
    out = [(wide.lower(), 0)]
    if c in LOOK_ALIKE:
        out += [(x.lower(), 0) for x in AMBIGUOUS.get(c, LOOK_ALIKE[c])]
    if _bare(wide) != wide.lower():
        out.append((_bare(wide), ACCENT))
    return list(dict.fromkeys(out))


@lru_cache(maxsize=10_000)
def _bare(c: str) -> str:
    """Without accents, in lower case."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower()


def trie(vocabulary: list[tuple[str, int]]) -> dict:
    root: dict = {}
    for word, n in vocabulary:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (n, word)
    return root


def _steps(node: dict, reading: str) -> Iterator[tuple[dict, int]]:
    """Where a reading leads to, and by which cost: the vocabulary may have an
    accent where it has none."""
    if not reading:
        yield node, 0
        return
    for c, to in node.items():
        if c and c == reading[0]:
            cost = 0
        elif c and _bare(c) == reading[0]:
            cost = ACCENT
        else:
            continue
        for end, more in _steps(to, reading[1:]):
            yield end, cost + more


def spelling(root: dict, token: str, most: int = 0) -> str | None:
    """The vocabulary's spelling of a token: the cheapest, then the most
    frequent, then the first in the alphabet. None if all cost over ``most``."""
    token = unicodedata.normalize("NFC", token.translate(_DROP_ALL))
    states = [(root, 0)]
    for c in token:
        after: dict[int, tuple[dict, int]] = {}
        readings = _readings(c)
        for node, cost in states:
            for reading, own in readings:
                for to, step in _steps(node, reading):
                    all_ = cost + own + step
                    if all_ <= most and (id(to) not in after or after[id(to)][1] > all_):
                        after[id(to)] = (to, all_)
        states = list(after.values())
    ends = [(cost, -node[""][0], node[""][1]) for node, cost in states if "" in node]
    return min(ends)[2] if ends else None


def _in_case(word: str, like: str) -> str:
    """The lower-case word with the capitals of another spelling."""
    return "".join(a.upper() if b.isupper() else a for a, b in zip(word, like, strict=True)) if len(word) == len(like) else word


def variants(text: str, spelled: dict[str, str]) -> int:
    """Kinds of variants in a text. spelled: the form chosen for its tokens."""
    kinds = 0
    for c in set(text):
        if c < "\x80":
            continue
        if unicodedata.category(c) == "Zs":
            kinds |= SPACE
        elif unicodedata.normalize("NFKC", c) != c:
            kinds |= COMPATIBILITY
        elif unicodedata.combining(c) and unicodedata.normalize("NFC", text) != text:
            kinds |= DECOMPOSED
    if len(_drop_invisible(text)) < len(text):
        kinds |= INVISIBLE
    for token, form in spelled.items():
        if form != unicodedata.normalize("NFKC", token.translate(_DROP_ALL)):
            kinds |= LOOK
    return kinds


def rebuilt(text: str, spelled: dict[str, str]) -> str:
    """The text in its consistent form."""
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if m[0] in spelled:
            out += [text[at : m.start()], spelled[m[0]]]
            at = m.end()
    out.append(text[at:])
    whole = unicodedata.normalize("NFKC", _drop_invisible("".join(out)))
    return whole if whole.isascii() else _SPACES.sub(" ", whole)


def _suspect(token: str) -> bool:
    return any(c in LOOK_ALIKE or c in ZERO_WIDTH or unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c for c in token if c > "\x7f")


_WORDS = "kind int, grp string, id long, text string, word string, skeleton long, n long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: plain words and counts; 1: tokens to look up; 2: texts that
    aren't pure ASCII."""
    for batch in batches:
        flat: list[str] = []
        tokens: list[tuple[str, int, str]] = []
        wide: list[tuple[str, int, str]] = []
        for grp, id_, text in zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text.isascii():
                flat += _PLAIN.findall(text.lower())
                continue
            wide.append((grp, id_, text))
            mine = dict.fromkeys(_TOKEN.findall(text))
            for t in mine:
                if t.isascii():
                    flat.append(t.lower())
                elif _suspect(t):
                    tokens.append((grp, id_, t))
                else:
                    flat.append(t.lower())
        codes, unique = pd.factorize(np.asarray(flat, dtype=object))
        count = np.bincount(codes, minlength=len(unique)) if len(codes) else np.empty(0, np.int64)
        shape = hash_words([skeleton(w) if not w.isascii() else w.translate(_SAME_SHAPE) for w in unique]).view(np.int64)
        token_shape = hash_words([skeleton(t[2]) for t in tokens]).view(np.int64)
        a, b, c = len(unique), len(tokens), len(wide)
        none = [None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.asarray([0, 1, 2], np.int32), [a, b, c])),
                pa.array(none * a + [t[0] for t in tokens + wide], pa.string()),
                pa.array(none * a + [t[1] for t in tokens + wide], pa.int64()),
                pa.array(none * (a + b) + [t[2] for t in wide], pa.string()),
                pa.array([*unique, *(t[2] for t in tokens), *none * c], pa.string()),
                pa.array([*shape.tolist(), *token_shape.tolist(), *none * c], pa.int64()),
                pa.array([*count.tolist(), *none * (b + c)], pa.int64()),
            ],
            ["kind", "grp", "id", "text", "word", "skeleton", "n"],
        )


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by skeleton, vocabulary (with n) first; one form per token."""
    shape, vocabulary, root = None, [], None
    for batch in batches:
        tokens, forms = [], []
        for s, word, n in zip(batch.column("skeleton").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if s != shape:
                shape, vocabulary, root = s, [], None
            if n is not None:
                vocabulary.append((word, n))
                continue
            root = trie(vocabulary) if root is None else root
            table = by_table(word)
            # a word with letters that no Latin word has stays as it is written
            found = spelling(root, word, MOST_COST) if is_disguised(unicodedata.normalize("NFKC", word.translate(_DROP_ALL))) or table.lower() != word.lower() else None
            tokens.append(word)
            forms.append(table if found is None else _in_case(found, table))
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(forms, pa.string())], ["word", "form"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kinds = [], []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            spelled = {x["word"]: x["form"] for x in pairs or ()}
            texts.append(rebuilt(text, spelled))
            # a text holds variants if its consistent form is another
            kinds.append(variants(text, spelled) if texts[-1] != text else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("grp"), batch.column("id"), pa.array(texts, pa.string()), pa.array(kinds, pa.int32())], ["grp", "id", "text", "variants"]
        )


def consistent_form(df: DataFrame, *, id_col: str, text_col: str, group_col: str | Column | None = None) -> DataFrame:
    """grp, id, text, variants: every row's text in its one consistent form,
    and the kinds of variants it held before (bits; 0: none).

    (group, id) identifies a text; every row comes out, also one that is delivered
    twice. Null texts stay null; empty texts and texts
    without variants stay as they are. Other columns are ignored.
    """
    group = F.lit("") if group_col is None else F.col(group_col) if isinstance(group_col, str) else group_col
    rows = df.select(F.coalesce(group.cast("string"), F.lit("")).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ascii_only = F.coalesce(~F.col("text").rlike(r"[^\x00-\x7f]"), F.lit(True))
    found = materialise(rows.where("text is not null").mapInArrow(_words, _WORDS), "tokens")

    vocabulary = found.where("kind = 0").groupBy("skeleton", "word").agg(F.sum("n").alias("n"))
    tokens = found.where("kind = 1").select("skeleton", "word").distinct().withColumn("n", F.lit(None).cast("long"))
    forms = (
        vocabulary.unionByName(tokens)
        .repartition(shuffle_width(df.sparkSession), "skeleton")
        .sortWithinPartitions("skeleton", F.col("n").isNull())
        .mapInArrow(_spell, "word string, form string")
    )
    # disguised words are few, one of them may stand in any part of the texts
    forms = materialise(forms, "forms")
    held = forms.agg(F.sum(F.octet_length("word") + F.octet_length("form"))).first()[0] or 0
    forms = F.broadcast(forms) if held <= MOST_FORMS else forms
    per_row = (
        found.where("kind = 1").select("grp", "id", "word").join(forms, "word").groupBy("grp", "id").agg(F.collect_list(F.struct("word", "form")).alias("pairs"))
    )
    wide = found.where("kind = 2").select("grp", "id", "text").join(per_row, ["grp", "id"], "left").mapInArrow(_rebuild, "grp string, id long, text string, variants int")
    return rows.where(ascii_only).withColumn("variants", F.lit(0)).unionByName(wide)
