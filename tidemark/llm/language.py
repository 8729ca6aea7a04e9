"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through
time. It labels every byte of a word; a document's probabilities are the mean over all its bytes.

The network starts anew at each word, so equal words have equal labels and each distinct word of a worker is read once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, fresh, text_bytes

WORD = regex.compile(r"\p{L}+")  # letters are category L: neither digits of any kind nor numerals
STEPS = 20  # bytes of a piece: longer words are read in pieces
EMBED, HIDDEN = 10, 16
CACHED = 300_000  # words whose labels a worker remembers
UNKNOWN = "und"


def pieces(word: bytes) -> list[bytes]:
    return [word[i:i + STEPS] for i in range(0, len(word), STEPS)]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words as rows, and which cells hold a byte."""
    width = max(map(len, words))
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return flat.astype(np.int64), np.arange(width) < lengths[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


@dataclass
class BiGru:
    """Parameters by name: embedding E; for each direction d in f, b: W{d} (input to gates), U{d} (state to gates), c{d};
    output Vf, Vb, v. Gates in the order update, reset, candidate."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int = 1) -> BiGru:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"E": (0.3 * rng.standard_normal((256, EMBED))).astype(np.float32), "v": np.zeros(len(languages), np.float32)}
        for d in "fb":
            p |= {f"W{d}": init(EMBED, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"V{d}": init(HIDDEN, len(languages))}
        return cls(languages, p)

    def run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction at every step; with keep also what the backward pass needs."""
        w, u, c, h = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"], np.zeros((x.shape[0], HIDDEN), np.float32)
        table = self.p["E"] @ w + c  # the gates' input for each byte value
        states, tape = np.zeros((x.shape[1], x.shape[0], HIDDEN), np.float32), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, m = table[x[:, t]], mask[:, t, None]
            r = h @ u[:, :2 * HIDDEN]
            zr = sigmoid(a[:, :2 * HIDDEN] + r)
            z, g = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN:] + (g * h) @ u[:, 2 * HIDDEN:])
            new = np.where(m, (1 - z) * h + z * n, h)
            if keep:
                tape.append((t, h, z, g, n))
            h = new
            states[t] = h
        return states, tape

    def labels(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte: (words, bytes, languages)."""
        f, b = self.run("f", x, mask, False)[0], self.run("b", x, mask, False)[0]
        out = f @ self.p["Vf"] + b @ self.p["Vb"] + self.p["v"]
        out = np.exp(out - out.max(axis=2, keepdims=True))
        return (out / out.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over bytes, by backpropagation through time."""
        p = self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        runs = {d: self.run(d, x, mask, True) for d in "fb"}
        out = runs["f"][0] @ p["Vf"] + runs["b"][0] @ p["Vb"] + p["v"]
        out = np.exp(out - out.max(axis=2, keepdims=True))
        out /= out.sum(axis=2, keepdims=True)
        out[:, np.arange(len(y)), y] -= 1
        out *= mask.T[:, :, None] / mask.sum()
        g["v"] = out.sum(axis=(0, 1))
        for d in "fb":
            states, tape = runs[d]
            g[f"V{d}"] = np.einsum("tbh,tbl->hl", states, out)
            into = out @ p[f"V{d}"].T
            u, w = p[f"U{d}"], p[f"W{d}"]
            dh = np.zeros((x.shape[0], HIDDEN), np.float32)
            da_by = np.zeros((256, 3 * HIDDEN), np.float32)
            for t, h, z, r, n in reversed(tape):
                m = mask[:, t, None]
                dh = dh + into[t]
                now = np.where(m, dh, 0)
                dn = now * z * (1 - n * n)
                dz = now * (n - h) * z * (1 - z)
                back = dn @ u[:, 2 * HIDDEN:].T
                dr = back * h * r * (1 - r)
                da = np.concatenate((dz, dr, dn), axis=1)
                g[f"U{d}"][:, :2 * HIDDEN] += h.T @ da[:, :2 * HIDDEN]
                g[f"U{d}"][:, 2 * HIDDEN:] += (r * h).T @ dn
                np.add.at(da_by, x[:, t], da)
                dh = np.where(m, now * (1 - z) + back * r + da[:, :2 * HIDDEN] @ u[:, :2 * HIDDEN].T, dh)
            g[f"c{d}"] = da_by.sum(axis=0)
            g[f"W{d}"] = p["E"].T @ da_by
            g["E"] += da_by @ w.T
        return g


def trained(words: list[tuple[bytes, str]], seed: int = 1, steps: int = 300, batch: int = 384) -> BiGru:
    """Adam steps on word pieces drawn evenly over the languages."""
    languages = sorted({y for _, y in words})
    net = BiGru.new(languages, seed)
    if len(languages) < 2:
        return net
    by = [[w for w, y in words if y == k] for k in languages]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        x, mask = padded([by[k][rng.integers(len(by[k]))] for k in y])
        rate = 0.015 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, g in net.gradients(x, mask, y).items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = net.p[k] - (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit_language(docs: DataFrame, folds: int = 5, held: int = 0, max_docs: int = 400, max_words: int = 20_000, max_languages: int = 200,
                 id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGru:
    """Fit on words of at most max_docs documents of each language outside the held-out fold (smallest hashes of the id), at
    most max_words words of a language. The sample's words are picked in Spark and come to the driver, max_languages at
    most (the most frequent)."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), folds) != held))
    known = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    picked = None
    for r in known:
        ids = rows.filter(F.col(lang_col) == r.lang).select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
        picked = ids if picked is None else picked.unionByName(ids)
    if picked is None:
        return BiGru.new([])
    share = max(1, max_words // max_docs)

    def words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            out, y = [], []
            for t, lang in zip(frame["t"], frame["lang"]):
                own = WORD.findall(bytes(t).decode("utf-8", "replace").lower())
                step = max(1, len(own) // share)
                found = [p for w in own[::step][:share] for p in pieces(w.encode())]
                out += found
                y += [lang] * len(found)
            yield pd.DataFrame({"w": pd.Series(out, dtype=object), "lang": pd.Series(y, dtype=object)})

    sample = rows.select(F.col(id_col).alias("__id"), text_bytes(F.col(text_col)).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    sample = sample.join(F.broadcast(picked.distinct()), "__id").select("t", "lang")  # at most max_docs * max_languages ids
    got = sample.mapInPandas(words, "w binary, lang string").toPandas()
    return trained(sorted((bytes(w), y) for w, y in zip(got["w"], got["lang"]) if len(w)))


class WordLabels(dict):
    """Word -> sum of its bytes' probabilities and their number."""

    def __init__(self, net: BiGru):
        super().__init__()
        self.net = net

    def learn(self, words: list[str]) -> None:
        if len(self) + len(words) > CACHED:
            self.clear()
        parts = [(p, k) for k, w in enumerate(words) for p in pieces(w.encode())]
        parts.sort(key=lambda p: len(p[0]))
        sums = np.zeros((len(words), len(self.net.languages) + 1))
        for at in range(0, len(parts), 1024):
            own = parts[at:at + 1024]
            x, mask = padded([p for p, _ in own])
            probs = self.net.labels(x, mask) * mask[:, :, None]
            np.add.at(sums, [k for _, k in own], np.concatenate((probs.sum(axis=1), mask.sum(axis=1, keepdims=True)), axis=1))
        for w, s in zip(words, sums):
            self[w] = s


def predict_language(docs: DataFrame, net: BiGru, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language of every whole text and its mean probability; columns of these names are replaced.
    A text that is null or has no letter is `und` with score 0, as is every text if no language was learned."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordLabels(net)
        for part in texts:
            out = []
            for at in range(0, len(part), 64):
                counts = [Counter(WORD.findall(bytes(t).decode("utf-8", "replace").lower())) for t in part.iloc[at:at + 64]]
                wanted = {w for c in counts for w in c}
                if net.languages:
                    missing = sorted(wanted.difference(known))
                    if missing:
                        known.learn(missing)
                        if not known.keys() >= wanted:  # emptied before
                            known.learn(sorted(wanted.difference(known)))
                for c in counts:
                    if not c or not net.languages:
                        out.append((UNKNOWN, 0.0))
                        continue
                    total = np.array(list(c.values()), dtype=np.float64) @ np.array([known[w] for w in c])
                    mean = total[:-1] / total[-1]
                    best = int(mean.argmax())
                    out.append((net.languages[best], float(min(1.0, mean[best]))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    taken = {lang_col.lower(), score_col.lower()}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    found = fresh(docs, "__p")
    return docs.select(*keep, predict(text_bytes(F.col(text_col))).alias(found)).select(*keep, F.col(f"{found}.lang").alias(lang_col), F.col(f"{found}.score").alias(score_col))
