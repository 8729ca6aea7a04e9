"""Toxicity: a lexicon learned from labels, met by Levenshtein automata over a trie, and scores of the words around a hit.

Terms are whole words and stems (a stem meets every word that begins with it). A token within the edits its term allows is
a hit; a hit between quotation marks, or near reporting marks, counts as quoted. A logistic model with Gaussian priors
weighs exact, misspelled and quoted hits and the densest window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import fresh, label_counts, labelled_sample, text_bytes, written

WINDOW = 8  # tokens on either side of a hit
STEMS = (4, 5, 6)  # letters of a stem
CACHED = 400_000  # tokens whose verdict a worker remembers
MAX_TERMS = 500
OPENING, CLOSING = "\"'“”„«»‘’‚‹›`", "\"'“”«»‘’‹›`"
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NO_HIT, EXACT, FUZZY = 0, 1, 2


def letters(word: str) -> int:
    """The set of a word's letters as bits."""
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) & 63)
    return bits


class LevenshteinTrie:
    """Terms in a trie; `find(word)` walks the trie in step with the Levenshtein automaton of the word.

    An automaton state maps positions in the word to the edits spent so far; a trie path without a position within the
    limit is cut. A word term of fewer than 5 letters allows no edit, of fewer than 9 one, a longer one two; a stem allows
    none, as any word may follow it. Words that share no unchanged part and no letters with a term skip the walk.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.root: dict = {}
        self.exact = set(words)
        self.stems = set(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        # word length -> (from, to, part of a term -> letter sets of its terms): what an acceptable word keeps unchanged
        cuts: dict[int, dict[tuple[int, int], dict[str, list[int]]]] = {}
        for term in words:
            node, limit, n = self.root, self.edits(term), len(term)
            for ch in term:
                node = node.setdefault(ch, {})
            node["word"] = limit
            size = n // (limit + 1)
            for k in range(limit + 1 if limit else 0):  # within `limit` edits one of limit + 1 parts stays
                lo, hi = k * size, n if k == limit else (k + 1) * size
                for m in range(n - limit, n + limit + 1):
                    for d in {0} if k == 0 else {m - n} if k == limit else range(-limit, limit + 1):
                        if lo + d >= 0:
                            cuts.setdefault(m, {}).setdefault((lo + d, hi + d), {}).setdefault(term[lo:hi], []).append(letters(term))
        self.cuts = {m: [(lo, hi, parts) for (lo, hi), parts in sorted(c.items())] for m, c in cuts.items()}

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def near(self, word: str) -> bool:
        """False only if no term is within its edits of the word."""
        for lo, hi, parts in self.cuts.get(len(word), ()):
            if word[lo:hi] in parts:
                own = letters(word)
                if any((own ^ x).bit_count() <= 4 for x in parts[word[lo:hi]]):
                    return True
        return False

    def find(self, word: str) -> int:
        if word in self.exact:
            return EXACT
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return EXACT
        return FUZZY if self.near(word) and self.walk(word) else NO_HIT

    def walk(self, word: str) -> bool:
        """Whether some term of the trie is accepted."""
        n = len(word)
        stack = [(self.root, {0: 0, 1: 1, 2: 2})]
        while stack:
            node, state = stack.pop()
            if "word" in node and state.get(n, 9) <= node["word"]:
                return True
            for ch, child in node.items():
                if len(ch) > 1:
                    continue
                after: dict[int, int] = {}
                for i, e in state.items():
                    steps = [(i, e + 1), (i + 1, e if word[i:i + 1] == ch else e + 1)]  # the term has a letter more; same or other letter
                    for j, f in steps:
                        while f <= 2 and j <= n and f < after.get(j, 9):
                            after[j] = f
                            j, f = j + 1, f + 1  # the word has a letter more
                if after:
                    stack.append((child, after))
        return False


class Verdicts(dict):
    """Token -> kind of hit, worked out once per distinct token of a worker; emptied when it holds too many."""

    def __init__(self, trie: LevenshteinTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[token] = self.trie.find(token if token.isalnum() else EDGES.sub("", token))
        return found


def quoted(tokens: list[str], at: int) -> bool:
    """Whether the token stands between an opening and a closing quotation mark within the window."""
    for i in range(at, max(-1, at - WINDOW - 1), -1):
        if tokens[i][:1] in OPENING and tokens[i][:1]:
            break
        if i < at and tokens[i].rstrip(".,;:!?)")[-1:] in CLOSING and tokens[i].rstrip(".,;:!?)")[-1:]:
            return False
    else:
        return False
    return any(t.rstrip(".,;:!?)")[-1:] in CLOSING and t.rstrip(".,;:!?)") for t in tokens[at:at + WINDOW + 1])


FEATURES = ("bias", "exact", "misspelled", "quoted", "densest")
PRIOR = np.array([-3.0, 3.0, 1.5, 0.0, 0.5])  # prior means; a kind of hit that no label shows keeps its own
PRIOR_SD = np.array([0.4, 2.5, 1.5, 1.0, 1.0])


def context(text: str, verdicts: Verdicts) -> tuple[list[float], list[tuple[int, int]]]:
    """Features of a whole text, and its hits as (token number, kind)."""
    tokens = text.lower().split()
    hits = [(i, k) for i, k in enumerate(map(verdicts.__getitem__, tokens)) if k]
    exact = fuzzy = cited = 0
    dense, left = 0, 0
    own = []
    for i, kind in hits:
        if quoted(tokens, i):
            cited += 1
            continue
        own.append(i)
        exact += kind == EXACT
        fuzzy += kind == FUZZY
        while own[left] < i - WINDOW:
            left += 1
        dense = max(dense, len(own) - left)
    return [1.0, math.log1p(exact), math.log1p(fuzzy), math.log1p(cited), math.log1p(max(0, dense - 1))], hits


@dataclass
class ToxicityModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def verdicts(self) -> Verdicts:
        return Verdicts(LevenshteinTrie(self.words, self.stems))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Maximum a posteriori weights by Newton steps; a row counts `times`."""
    w, precision = PRIOR.copy(), np.diag(PRIOR_SD ** -2.0)
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (times * p * (1 - p))) @ x + precision, x.T @ (times * (y - p)) - precision @ (w - PRIOR))
        w = w + step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
    return w


@F.pandas_udf(T.LongType())
def signature(texts: pd.Series) -> pd.Series:
    """Smallest hash of five successive words: copies and most near copies of a text share it."""
    out = []
    for t in texts:
        w = bytes(t).lower().split()
        out.append(min((xxh3_64_intdigest(b" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
    return pd.Series(out)


def lexicon(sample: DataFrame, surprise: float = 20.0, max_terms: int = MAX_TERMS) -> tuple[list[str], list[str]]:
    """Words and stems that toxic documents hold far more often (log-likelihood ratio of at least `surprise` and eight
    times the rate). Near copies count once. Counted in Spark over the bounded sample, first where the label is 1, then the terms found there in
    the rest; at most max_terms terms come to the driver."""

    def terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            out = []
            for text in frame["text"]:
                words = {EDGES.sub("", t) for t in bytes(text).decode("utf-8", "replace").lower().split()} - {""}
                out += {f"w{w}" for w in words if len(w) >= 3} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n}
            yield pd.DataFrame({"term": out})

    sample = written(sample.groupBy("y", signature("text").alias("sig")).agg(F.min("text").alias("text")), "texts")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return [], []
    inside = sample.filter("y = 1").select("text").mapInPandas(terms, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("t"))
    inside = written(inside.filter((F.col("t") >= 3) & (F.col("t") >= 0.01 * pos)), "lexicon")
    outside = sample.filter("y = 0").select("text").mapInPandas(terms, "term string").join(inside.select("term"), "term", "left_semi")
    counted = inside.join(outside.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").fillna(0, ["n"])
    t, n = F.col("t"), F.col("n")
    share = F.lit(pos / (pos + neg))
    gain = 2 * (t * F.log(t / ((t + n) * share)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - share)))).otherwise(0.0))
    best = (
        counted.filter((t >= 3) & ((n + 0.5) / (neg + 1) * 8 <= (t + 0.5) / (pos + 1))).withColumn("gain", gain)
        .filter(F.col("gain") >= surprise).orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    )
    gains = {r.term: r.gain for r in best}
    stems: list[str] = []
    for term in sorted((x for x in gains if x[0] == "s"), key=lambda x: (-len(x), x)):
        stem = term[1:]
        longer = [gains[f"s{s}"] for s in stems if s.startswith(stem)] + [g for w, g in gains.items() if w == f"w{stem}" or w[0] == "w" and w[1:].startswith(stem)]
        # a stem stands for more than one word or longer stem: it must explain clearly more than the best of them
        if all(gains[term] > 1.2 * g for g in longer):
            stems = [s for s in stems if not s.startswith(stem)] + [stem]
    words = [x[1:] for x in gains if x[0] == "w" and not any(x[1:].startswith(s) for s in stems)]
    return sorted(words), sorted(stems)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 10_000, label: str = "toxic") -> ToxicityModel:
    """Lexicon and weights from at most max_rows labelled documents of each class outside the held-out fold; a sampled row
    counts for as many labelled rows as its class has for each of the sample. Without both labels the lexicon is empty and
    every text scores low."""
    sample = written(labelled_sample(docs, labels, label, folds, held, max_rows), "toxicity")
    words, stems = lexicon(sample)
    model = ToxicityModel(words, stems)

    def features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verdicts = model.verdicts()
        for frame in it:
            yield pd.DataFrame({"x": [context(bytes(t).decode("utf-8", "replace"), verdicts)[0] for t in frame["text"]], "y": frame["y"].to_numpy()})

    # rows of equal features are summed in Spark; few distinct ones come to the driver
    rows = sample.mapInPandas(features, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: (r.y, r.x))
    y, n = np.array([r.y for r in rows], dtype=int), np.array([r.n for r in rows], dtype=float)
    each = label_counts(docs, labels, label, folds, held) / np.maximum(1, np.bincount(y, weights=n, minlength=2))
    model.weights = logistic(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), y.astype(float), n * each[y])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of every whole text in score_col, which replaces a column of that name. One narrow
    pass. A null text counts as empty and scores as a text without hits; repeated rows score alike."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        verdicts = model.verdicts()
        for part in texts:
            x = np.array([context(bytes(t).decode("utf-8", "replace"), verdicts)[0] for t in part]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return docs.withColumn(score_col, score(text_bytes(F.col(text_col))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit: object) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    name = fresh(docs, "__score")
    scored = score_toxicity(docs, fit_toxicity(docs, labels, **fit), score_col=name)
    return scored.filter(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
