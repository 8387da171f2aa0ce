"""Reading level of documents: a linear pairwise ranker, calibrated.

From documents that people have graded, pairs of different grade are made; a
linear model of syntax and vocabulary features learns which of the two is the
more demanding. Its scores become grades by isotonic regression: the mean
grade at a score, made to rise with the score. All documents are then scored.
Every feature is of the whole text; those that have no bound grow by root or
logarithm, so that a text without full stops doesn't outweigh all others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most graded documents that the ranker is fitted on, chosen by hash; pairs
#: made of each.
MOST_LABELS, PAIRS_EACH = 20_000, 24
#: Grades that a document may lie off the fitted ones before it is left out of
#: the second fit.
FAR_OFF = 3.0
#: Words of the stretches in which different words are counted: their number
#: grows with the length of a text, so that texts are compared by equal ones.
STRETCH = 400
# Words that open a subordinate clause.
SUBORDINATE = (
    "although because since unless until whereas whether which while whose that if when though whom except given "
    "weil obwohl dass wenn während nachdem sofern porque aunque cuando mientras si parce quoique lorsque puisque afin"
).split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOP = re.compile(r"[.!?]+(?:\s|$)|\n{2,}")
_VOWELS = re.compile(r"[aeiouyáéíóúàèìòùâêîôûäëïöüœæ]+")
_OPENS_CLAUSE = frozenset(SUBORDINATE).__contains__
FEATURES = (
    "root of words per sentence", "log words per sentence", "letters per word", "syllables per word", "words of 9 letters", "words of 7 letters", "words of 12 letters",
    "words of 3 letters or fewer", "log commas and semicolons per sentence", "log clauses per sentence", "different words", "spread of word length",
)


def _different(words: list[str]) -> float:
    """How many different words a stretch has, as the mean over all stretches
    of a text, each weighted by its length."""
    total = 0.0
    for at in range(0, len(words), STRETCH):
        own = words[at : at + STRETCH]
        total += len(set(own)) * len(own) ** 0.2  # their share by the power 0.8 of the length, times the length
    return total / len(words)


def features(text: str | None) -> list[float] | None:
    """Numbers of FEATURES; none for a text without words."""
    low = text.lower() if text else ""
    words = _WORD.findall(low)
    if not words:
        return None
    n = len(words)
    sentences = max(1, sum(1 for x in _STOP.split(low) if x and not x.isspace()))
    sizes = np.bincount(np.fromiter(map(len, words), np.int64, n))
    many = np.arange(len(sizes))
    mean = float(sizes @ many) / n
    spread = max(0.0, float(sizes @ (many * many)) / n - mean * mean) ** 0.5
    share = lambda a, b=None: int(sizes[a:b].sum()) / n
    per = n / sentences
    return [
        math.sqrt(per), math.log1p(per), mean, len(_VOWELS.findall(low)) / n, share(9), share(7), share(12), share(0, 4),
        math.log1p((low.count(",") + low.count(";")) / sentences), math.log1p(sum(map(_OPENS_CLAUSE, words)) / sentences),
        _different(words), spread,
    ]


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    score_at: np.ndarray
    grade_at: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), self.score_at, self.grade_at)


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to the grades, by its blocks' means."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of grades, sum of scores, size
    for s, g in zip(score[order], grade[order], strict=True):
        blocks.append([g, s, 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    size = np.asarray([b[2] for b in blocks])
    return np.asarray([b[1] for b in blocks]) / size, np.asarray([b[0] for b in blocks]) / size


def _rank(x: np.ndarray, grade: np.ndarray, seed: int, steps: int = 300) -> np.ndarray:
    """Weights by which the more demanding document of a pair scores higher."""
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(len(x)), PAIRS_EACH)
    b = rng.integers(0, len(x), len(a))
    apart = np.abs(grade[a] - grade[b]) >= 1
    a, b = a[apart], b[apart]
    up = np.sign(grade[a] - grade[b])[:, None] * (x[a] - x[b])
    weight, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        slope = up.T @ (-1 / (1 + np.exp(np.clip(up @ weight, -30, 30)))) / max(1, len(up)) + 1e-3 * weight
        speed = 0.9 * speed - 0.3 * slope
        weight = weight + speed
    return weight


def fit(x: np.ndarray, grade: np.ndarray, seed: int = 42) -> Ranker:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - mean) / scale
    keep = np.ones(len(x), bool)
    for last in (False, True):
        weight = _rank(z[keep], grade[keep], seed)
        at, level = isotonic(z[keep] @ weight, grade[keep])
        if not last:
            # a few grades are far off: they don't take part in the second fit
            keep = np.abs(np.interp(z @ weight, at, level) - grade) <= FAR_OFF
    return Ranker(mean, scale, weight, at, level)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(rows, pa.list_(pa.float64()))], ["id", "grade", "x"])


def fit_ranker(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, grade_col: str, seed: int = 42, most: int = MOST_LABELS) -> Ranker:
    """Fit on at most ``most`` graded documents; a document's grade is the
    mean of its raters'. Labels without a document, and documents without
    words, are left out; a document delivered twice counts once."""
    grades = labels.where(F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(grade_col).alias("grade"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most ``most`` ids and grades
    chosen = grades.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)
    graded = texts.join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))
    rows = [r for r in graded.mapInArrow(_features, "id long, grade double, x array<double>").collect() if r.x]
    if len({r.grade for r in rows}) < 2:
        raise ValueError("two graded documents of different grade are needed")
    rows.sort(key=lambda r: r.id)
    return fit(np.asarray([r.x for r in rows]), np.asarray([r.grade for r in rows]), seed)


def reading_levels(docs: DataFrame, ranker: Ranker, *, id_col: str, text_col: str) -> DataFrame:
    """id_col, level: the estimate for every row, on the scale of the grades;
    null for null texts and texts without words. A row that comes twice has
    two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column("text")]
            known = np.asarray([r is not None for r in rows], bool)
            level = np.zeros(len(rows))
            if known.any():
                level[known] = ranker.level(np.asarray([r for r in rows if r is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(level, pa.float64(), mask=~known)], [id_col, "level"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, level double")
