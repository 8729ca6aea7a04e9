"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and towards its diagonal. The score is the
logistic of the difference of log densities plus the log prior odds; the Cholesky factors are computed once, at the fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, label_counts, labelled_sample, text_bytes

STATS = (
    "log_words", "word_mean", "word_sd", "distinct", "top_word", "upper", "digit", "punct", "high", "line_words",
    "line_repeat", "doubled_marks", "led_by_mark", "short_words",
)
_KIND = np.zeros(256, dtype=np.int64)  # 0 letter, 1 white space, 2 upper case, 3 digit, 4 other ASCII, 5 above ASCII
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_KIND[[*range(9), *range(14, 32), 127]] = 4


DRAWN = 10  # statistics of short texts are drawn to the values below, as by so many words more


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text: shares as log odds with a floor, lengths as logs. An empty text has the
    values of a text with no words."""
    n = len(text)
    words = text.split()
    m = len(words)
    kind = _KIND[np.frombuffer(text + b"\n", dtype=np.uint8)]
    kinds = np.bincount(kind, minlength=6)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=m)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    mark, space = kind == 4, kind == 1
    doubled = int((mark[:-2] & mark[1:-1] & space[2:]).sum()) if n > 1 else 0
    led = int((space[:-1] & mark[1:]).sum()) + int(mark[0])
    shown = max(0, n + 1 - int(kinds[1]))

    def odds(count: float, total: float, drawn: float, of: float = DRAWN, floor: float = 0.005) -> float:
        share = (count + of * drawn) / (total + of)
        return float(np.log((share + floor) / (1.0 - share + floor)))

    mean = (lengths.sum() + DRAWN * 5.0) / (m + DRAWN)
    spread = ((lengths.var() * m if m else 0.0) + DRAWN * 6.0) / (m + DRAWN)
    return [
        float(np.log1p(m)), float(np.log(mean)), float(np.log(spread) / 2),
        odds(len(counts), m, 0.8), odds(max(0, top - 1), m, 0.04), odds(int(kinds[2]), shown, 0.02, 5 * DRAWN), odds(int(kinds[3]), shown, 0.0, 5 * DRAWN),
        odds(int(kinds[4]), shown, 0.025, 5 * DRAWN), odds(int(kinds[5]), shown, 0.02, 5 * DRAWN), float(np.log1p(m / max(1, len(lines)))),
        odds(len(lines) - len(set(lines)), len(lines), 0.0), odds(doubled, m, 0.0), odds(led, m, 0.0), odds(int((lengths <= 3).sum()), m, 0.3),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of the two classes."""

    low: np.ndarray
    high: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0], -40.0, 40.0)))


def discriminant(x: np.ndarray, y: np.ndarray, shrink: float = 0.5, ridge: float = 0.05, counts: np.ndarray | None = None) -> Discriminant:
    """Fit from rows of statistics. shrink moves a class covariance to the pooled one, ridge moves that to its diagonal.
    counts are the rows of label 0 and 1 that x stands for (its own if None): they give the prior and the pooled covariance.
    Statistics outside the range seen at the fit count as its ends, so a longer text than any seen is no outlier. With
    fewer than two rows of a class the score is the share of label 1 (0.5 without rows)."""
    d = len(STATS)
    if counts is None:
        counts = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        p = (counts[1] + 0.5) / (counts.sum() + 1.0)
        return Discriminant(np.zeros(d), np.zeros(d), np.zeros((2, d)), np.zeros((2, d, d)), np.array([0.0, np.log(p / (1 - p))]))
    parts = [x[y == k] for k in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    shares = counts / counts.sum()
    pooled = sum(s * c for s, c in zip(shares, own))
    means, factors, offsets = [], [], []
    for part, cov, share in zip(parts, own, shares):
        weight = min(1.0, shrink + d / len(part))
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        chol = np.linalg.cholesky(cov)
        means.append(part.mean(axis=0))
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log(share) - np.log(np.diag(chol)).sum())
    return Discriminant(x.min(axis=0), x.max(axis=0), np.array(means), np.array(factors), np.array(offsets))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_rows: int = 10_000,
                label: str = "quality") -> Discriminant:
    """Fit on at most max_rows labelled documents of each class outside the held-out fold, with the prior of all of them. Only
    their statistics, a few numbers a row, come to the driver."""

    def stats(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            yield pd.DataFrame({"s": [statistics(bytes(t)) for t in frame["text"]], "y": frame["y"].to_numpy()})

    rows = labelled_sample(docs, labels, label, folds, held, max_rows).mapInPandas(stats, "s array<double>, y int").collect()
    rows.sort(key=lambda r: (r.y, r.s))  # sums of floats depend on the order of rows
    counts = label_counts(docs, labels, label, folds, held)
    return discriminant(np.array([r.s for r in rows]).reshape(-1, len(STATS)), np.array([r.y for r in rows]), counts=counts)


def score_quality(docs: DataFrame, model: Discriminant, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1, higher: label 1 likelier) of every whole text in score_col, which replaces a column of
    that name. One narrow pass: no shuffle, one text of state. A null text counts as empty; repeated rows are scored alike;
    an empty table gives an empty one."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array([statistics(bytes(t)) for t in part]).reshape(-1, len(STATS))
            yield pd.Series(model.score(x))

    return docs.withColumn(score_col, score(text_bytes(F.col(text_col))))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit: object) -> DataFrame:
    """The rows of docs that score at least the threshold, with the columns of docs."""
    name = fresh(docs, "__score")
    scored = score_quality(docs, fit_quality(docs, labels, **fit), score_col=name)
    return scored.filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
