"""Text normalisers as column expressions: evaluated in the JVM, null for null."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import patterns as P

TEXT_COLUMNS = ("body", "positive_example_1", "positive_example_2", "negative_example_1", "negative_example_2")
# Texts that CSV readers take for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Python's word characters and blanks, in Java's classes: Java's own take in
# marks and joiners, and leave out the separators \x1c to \x1f.
_WORD, _BLANK = r"\p{L}\p{N}_", r"\s\x1c-\x1f"
_TRANSLATED = {
    r"\w": f"[{_WORD}]", r"\s": f"[{_BLANK}]", r"\S": f"[^{_BLANK}]", r"\Z": r"\z",
    r"\b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
}
_IN_CLASS = {r"\w": _WORD, r"\s": _BLANK}


@lru_cache(maxsize=256)
def _translate(pattern: str) -> str:
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        if part == "[" and not inside or part == "]" and inside:
            inside = part == "["
        elif inside and part == "[":
            part = r"\["
        out.append((_IN_CLASS if inside else _TRANSLATED).get(part, part))
    return "".join(out).replace(_BLANK + r"\x1c-\x1f", _BLANK)


def java(step: P.Step) -> str:
    """The pattern as Java reads it, with the meaning that it has in Python."""
    return ("(?iuU)" if step.ignore_case else "(?U)") + _translate(step.pattern)


def apply_steps(text: Column | str, steps: Iterable[P.Step]) -> Column:
    out = _column(text)
    for step in steps:
        out = F.regexp_replace(out, java(step), step.replacement)
    return out


def _apply(text: Column | str, name: str) -> Column:
    """The steps of a normaliser, on texts that hold what they need."""
    if name not in P.NEEDS:
        return apply_steps(text, P.STEPS[name])
    # the text is evaluated once, as an element of an array
    step = lambda x: F.when(F.rlike(x, F.lit(P.NEEDS[name])), apply_steps(x, P.STEPS[name])).otherwise(x)
    return F.element_at(F.transform(F.array(_column(text)), step), 1)


def _normaliser(name: str, doc: str):
    def normalise(text: Column | str) -> Column:
        return _apply(text, name)

    normalise.__name__ = normalise.__qualname__ = f"normalize_{name}"
    normalise.__doc__ = doc
    return normalise


normalize_urls = _normaliser("urls", "Web addresses, also spaced ones, become <URL>.")
normalize_usernames = _normaliser("usernames", "u/name and @name become <USER>.")
normalize_emails = _normaliser("emails", "E-mail addresses become <EMAIL>.")
normalize_subreddits = _normaliser("subreddits", "r/name becomes <SUB>.")
normalize_phones = _normaliser("phones", "Phone numbers become <PHONE>.")
normalize_money = _normaliser("money", "Amounts of money become <MONEY>.")
normalize_random = _normaliser("random", "Codes of mixed letters, digits and signs become <RANDOM>.")
normalize_ips = _normaliser("ips", "Dotted quads are removed.")
normalize_timestamps = _normaliser("timestamps", "Dates and times of eight forms are removed.")
normalize_quotes = _normaliser("quotes", "Outer blanks go, then one pair of outer quotes.")
reduce_characters = _normaliser("characters", "Letters repeat at most twice, other characters not at all.")
reduce_words = _normaliser("words", "A repeated word stands once.")
reduce_whitespace = _normaliser("whitespace", "Runs of blanks and tabs become one blank; line ends stay.")


def normalize_text(text: Column | str) -> Column:
    """All twelve normalisers in their order. Not idempotent, as it never was."""
    return reduce(_apply, P.ORDER, _column(text))


def normalize_incremental(text: Column | str, *, strict: bool = True) -> Column:
    """The conservative pass over text that was normalised before.

    Placeholders are protected, repeats reduced, placeholders put back from
    left to right; a result longer than the text is dropped for the text.
    Two placeholders side by side collapse to one while protected. With
    ``strict`` the placeholders behind then move up by one, as they always
    did; without, each slot keeps a word of its own and nothing moves.
    """
    old = _column(text)
    shortened = apply_steps(old, (P.URL_WITH_DOMAIN,))

    def put_back(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(P.TOKEN), F.lit(0))
        slot = P.Step(P.TOKEN, P.SLOT if strict else "$1")
        protected = apply_steps(apply_steps(x, (slot,)), P.INCREMENTAL)
        if not strict:
            return F.regexp_replace(protected, "([A-Z]+)", "<$1>")
        return F.element_at(
            F.transform(
                F.array(F.struct(tokens.alias("tokens"), F.split(protected, P.SLOT, -1).alias("parts"))),
                lambda s: F.concat_ws(
                    "",
                    F.transform(
                        s["parts"],
                        lambda part, i: F.when(i == 0, part)
                        .when(i <= F.size(s["tokens"]), F.concat(F.get(s["tokens"], i - 1), part))
                        .otherwise(F.concat(F.lit(P.SLOT), part)),
                    ),
                ),
            ),
            1,
        )

    # the text is evaluated once, as an element of an array
    pair = F.transform(F.array(F.struct(old.alias("old"), shortened.alias("x"))), lambda s: F.struct(s["old"].alias("old"), put_back(s["x"]).alias("new")))
    chosen = F.transform(pair, lambda s: F.when(F.length(s["new"]) > F.length(s["old"]), s["old"]).otherwise(s["new"]))
    return F.when(old.isNotNull(), F.element_at(chosen, 1))


def normalize_text_columns(df: DataFrame, columns: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    """``df`` with the whole normaliser applied to its text columns; columns
    that it hasn't are left out."""
    return df.withColumns({c: normalize_text(c) for c in columns if c in df.columns})


def strip(text: Column | str) -> Column:
    """Without blanks of any kind at either end."""
    return apply_steps(text, (P.OUTER_BLANKS,))


def na_to_null(text: Column | str, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Null for texts that stand for a missing value."""
    x = _column(text)
    return F.when(~x.isin(*tokens), x)


def sanitized(text: Column | str) -> Column:
    """Stripped text; null for null, blank, and any case of "nan" and "none"."""
    x = strip(text)
    return F.when((x != "") & ~F.lower(x).isin("nan", "none"), x)


def rule_label(rule: Column | str, width: int = 50) -> Column:
    """The short form of a rule in reports."""
    return F.concat(F.substring(_column(rule), 1, width), F.lit("..."))


def rule_line(rule: Column | str) -> Column:
    """The line of a prompt that names the rule."""
    return F.concat(F.lit("Rule: "), _column(rule), F.lit("\n"))
