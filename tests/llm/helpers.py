"""Fixtures and brute-force versions for the tests of this folder."""

from __future__ import annotations

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# columns with names that the operators use for results of their own
CLASHES = ("score", "kept", "shard", "slot", "ids", "sequence_id", "offset", "n_words", "n_removed", "decoded", "__sid", "__score", "__key", "__row")


def bag(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 3) -> list[tuple]:
    """Nulls, empty and one-word texts, copies, near copies, a chain of near copies, shared passages, a very long text, and
    repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "One", "a b c", "a b c", "a b c d e", "x" * 30_000, "é ñ   ü"]
    base = bag(rng, 120)
    texts += [" ".join(base)] * 4
    for k in range(12):
        near = list(base)
        near[rng.randrange(120)] = f"z{k}"
        texts.append(" ".join(near))
    chain = bag(rng, 100)
    for k in range(6):
        chain = [*chain[4:], *bag(rng, 4)]
        texts.append(" ".join(chain))
    passage = " ".join(bag(rng, 60))
    for k in range(8):
        texts.append(" ".join((*bag(rng, rng.randrange(60)), passage, *bag(rng, rng.randrange(60)))))
    texts.append(f"{passage} {passage}")
    texts.append(" ".join(["same"] * 90))
    texts += [" ".join(bag(rng, n)) for n in (4, 5, 34, 35, 36, 5000)]
    rows = [(k, t, rng.choice(["en", "de", None]), "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[20], None, None, None), (None, None, None, None, None)]
    return rows


def documents(spark, rows=None, clashing: bool = False):
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("own") for c in CLASHES})
    return df


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode())


def shingle_set(text: str | None) -> frozenset:
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def jaccard_brute(rows: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row, in order of the rows."""
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return [(r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)]


def substring_brute(rows: list[tuple], length: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256 of the kept words) of each row."""
    seen: collections.Counter = collections.Counter()
    split = [words(r[1]) for r in rows]
    for w in split:
        seen.update(tuple(w[i:i + length]) for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
