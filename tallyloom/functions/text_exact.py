"""The same normalisers by Python's own regular expressions, a batch at a
time: the reference for the native ones in tests, and for engines whose Java
treats a character otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import patterns as P


def _compiled(step: P.Step) -> tuple[re.Pattern, str]:
    pattern = P.REPEATED if step is P.WORDS else step.pattern
    return re.compile(pattern, re.IGNORECASE if step.ignore_case else 0), re.sub(r"\$(\d)", r"\\\1", step.replacement)


def run_steps(text: str | None, names: tuple[str, ...]) -> str | None:
    if text is None:
        return None
    for name in names:
        for step in P.STEPS[name]:
            pattern, replacement = _compiled(step)
            text = pattern.sub(replacement, text)
    return text


def incremental(text: str | None) -> str | None:
    if text is None:
        return None
    new = re.sub(P.URL_WITH_DOMAIN.pattern, P.URL_WITH_DOMAIN.replacement, text)
    tokens = [m[0] for m in re.finditer(P.TOKEN, new)]
    new = re.sub(P.TOKEN, P.SLOT, new)
    for step in P.INCREMENTAL:
        pattern, replacement = _compiled(step)
        new = pattern.sub(replacement, new)
    parts = new.split(P.SLOT)
    slots = tokens[: len(parts) - 1] + [P.SLOT] * (len(parts) - 1 - len(tokens))
    new = parts[0] + "".join(a + b for a, b in zip(slots, parts[1:], strict=True))
    return text if len(new) > len(text) else new


def exact(text: Column | str, *names: str) -> Column:
    """Column of the named normalisers; "text" for all in their order,
    "incremental" for the pass over normalised text."""
    steps = P.ORDER if names == ("text",) else names

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(incremental if steps == ("incremental",) else lambda x: run_steps(x, steps), na_action="ignore")

    return F.pandas_udf(run, "string")(text)
