"""Removal of word windows that occur more than once, by suffix automata over shards of shared passages.

1. Every text is winnowed: each window of `length` words owns one anchor, the smallest hash of `GRAM` successive words in
   it. Equal windows own equal anchors. Anchors seen more than once are counted in Spark and set in a bit filter of
   bounded size (a wrongly set bit only costs work).
2. Around each anchor in the filter, the stretch of text that holds the windows it owns is written. Stretches that are
   equal are counted once, with their number.
3. Anchors whose stretches differ are dealt into shards. A shard's suffix automaton counts how often each path occurs;
   its own stretches are streamed over it for matching statistics, and a window is repeated if the state of its last
   `length` words occurs twice. Very many different stretches of one anchor are split by their words around it first.
4. Repeated windows go back to their texts, whose covered words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import bit_filter, frames, fresh, text_bytes, written

LENGTH = 35
GRAM = 8
SHARD = 1_500  # stretches of a shard, about
HOT = 2_000  # different stretches of one anchor beyond which they are split


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of `gram` words."""
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - gram + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j:j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def owners(words: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows, place of the anchor) of the runs of windows that own one anchor."""
    if len(words) < length:
        return (np.zeros(0, np.int64),) * 4
    g = gram_hashes(words, gram)
    span = length - gram + 1
    n = len(words) - length + 1
    # smallest hash of `span` successive ones and its first place, by doubling
    low, at, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = low[:-step], low[step:]
        left = a <= b
        low, at, width = np.where(left, a, b), np.where(left, at[:-step], at[step:]), width + step
    cuts = np.flatnonzero(np.diff(at[:n])) + 1
    first = np.concatenate(([0], cuts))
    count = np.diff(np.concatenate((first, [n])))
    return g[at[first]].view(np.int64), first, count, at[first]


class SuffixAutomaton:
    """Suffix automaton of several sequences; `occurs` holds how often the words of a state's paths occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.occurs = [-1], [0], [0]

    def add(self, sequence: list, times: int) -> None:
        last = 0
        for x in sequence:
            last = self.extend(last, x)
            self.occurs[last] += times

    def state(self, length: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.len.append(length)
        self.occurs.append(0)
        return len(self.len) - 1

    def split(self, p: int, x, q: int) -> int:
        """A copy of q for the shorter paths that come from p."""
        copy = self.state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, x) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self.split(last, x, q)
        new, p = self.state(self.len[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self.split(p, x, q)
        return new

    def finish(self) -> None:
        """Occurrences of a state count for all shorter paths on its suffix links."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.occurs[self.link[v]] += self.occurs[v]

    def repeated(self, sequence: list, length: int) -> int:
        """Matching statistics of a sequence: bit k is set if the `length` items from k on occur more than once."""
        bits, v, matched = 0, 0, 0
        for i, x in enumerate(sequence):
            while v and x not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            if x in self.next[v]:
                v, matched = self.next[v][x], matched + 1
            while v and self.len[self.link[v]] >= length:
                v = self.link[v]
                matched = self.len[v]
            if matched >= length and self.occurs[v] > 1:
                bits |= 1 << (i - length + 1)
        return bits


def repeated_windows(different: DataFrame, length: int, gram: int, halve: bool) -> DataFrame:
    """(fp, hash, mask) of stretches (fp, hash, times, windows, anchor, stretch), each once with how often it occurs: bit k
    is set if its window k occurs more than once in stretches of the same anchor.

    One kind of stretch needs only its count. A few kinds meet in the automaton of their shard. If there are very many, each
    stretch is halved: windows that reach far behind the anchor meet by the words there, the others by the words before it;
    halves of one kind are counted together. Halves that are still of very many kinds are counted window by window.
    """
    different = written(different, "different")
    per = different.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("seen")).filter("seen > 1")
    same = different.select("fp", "hash", "windows").join(per.filter("kinds = 1"), "fp").select("fp", "hash", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    mixed = written(different.join(per.filter("kinds > 1"), "fp"), "mixed")
    few, many = mixed.filter(F.col("kinds") <= HOT), mixed.filter(F.col("kinds") > HOT)
    shards = max(1, few.count() // SHARD)

    def automaton(frame: pd.DataFrame) -> pd.DataFrame:
        sam, names = SuffixAutomaton(), {}
        texts = [[names.setdefault(w, len(names)) for w in bytes(s).split()] for s in frame["stretch"]]
        for words, times in zip(texts, frame["times"]):
            sam.add(words, int(times))
        sam.finish()
        return pd.DataFrame({"fp": frame["fp"], "hash": frame["hash"], "mask": [sam.repeated(words, length) for words in texts]})

    by_shard = few.groupBy(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard")).applyInPandas(automaton, "fp long, hash long, mask long")
    done = same.unionByName(by_shard)
    if not many.limit(1).count():
        return done

    def windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            for fp, h, times, s in zip(frame["fp"], frame["hash"], frame["times"], frame["stretch"]):
                words = bytes(s).split()
                n = len(words) - length + 1
                yield pd.DataFrame({"fp": fp, "hash": h, "times": times, "k": range(n), "window": [b" ".join(words[k:k + length]) for k in range(n)]})

    middle = (length - gram + 1) // 2

    def halves(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            rows = []
            for fp, h, times, n, at, s in zip(frame["fp"], frame["hash"], frame["times"], frame["windows"], frame["anchor"], frame["stretch"]):
                words = bytes(s).split()
                cut = min(int(n), max(0, int(at) - middle + 1))  # windows before it reach at least `middle` words before the anchor
                for lo, hi, side, near in ((0, cut, b"<", words[max(0, at - middle):at + gram]), (cut, int(n), b">", words[at:at + length - middle + 1])):
                    if lo < hi:
                        part = b" ".join(words[lo:hi + length - 1])
                        names = [xxh3_64_intdigest(x) - (1 << 63) for x in (side + b" ".join(near), part)]
                        rows.append((fp, h, times, *names, lo, hi - lo, at - lo, part))
            yield pd.DataFrame(rows, columns=["fp", "hash", "times", "half", "part", "shift", "windows", "anchor", "stretch"])

    if not halve:
        single = many.select("fp", "hash", "times", "stretch").mapInPandas(windows, "fp long, hash long, times long, k int, window binary")
        single = single.withColumn("window", F.sha2("window", 256))
        twice = single.groupBy("window").agg(F.sum("times").alias("all")).filter("all > 1").select("window")
        return done.unionByName(single.join(twice, "window").groupBy("fp", "hash").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")))
    cut_up = many.select("fp", "hash", "times", "windows", "anchor", "stretch").mapInPandas(
        halves, "fp long, hash long, times long, half long, part long, shift int, windows int, anchor int, stretch binary")
    cut_up = written(cut_up, "halves")
    kinds = cut_up.groupBy(F.col("half").alias("fp"), F.col("part").alias("hash")).agg(
        F.sum("times").alias("times"), F.max("windows").alias("windows"), F.max("anchor").alias("anchor"), F.first("stretch").alias("stretch"))
    covered = repeated_windows(kinds, length, gram, halve=False).select(F.col("fp").alias("half"), F.col("hash").alias("part"), "mask")
    back = cut_up.select("fp", "hash", "half", "part", "shift").join(covered, ["half", "part"])
    return done.unionByName(back.groupBy("fp", "hash").agg(F.bit_or(F.expr("shiftleft(mask, shift)")).alias("mask")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   kept_col: str = "kept", words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """docs with kept_col (the kept words joined by one space), words_col and removed_col; columns of these names are
    replaced. A window is `length` successive words (runs of bytes other than ASCII white space); a word goes if a window
    that covers it occurs anywhere else, in the same text included. A null or empty text has no words. Rows that repeat are
    occurrences of each other. length is at most 64 + gram - 1.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (kept_col.lower(), words_col.lower(), removed_col.lower())])
    spark = docs.sparkSession
    k1, k2, raw, marks = (fresh(docs, c) for c in ("__k1", "__k2", "__raw", "__marks"))
    key = [F.xxhash64(F.lit(n), F.col(id_col), F.col(text_col)).alias(k) for n, k in ((1, k1), (2, k2))]
    plain = docs.select(*key, text_bytes(F.col(text_col)).alias(raw))

    def anchors(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            found = [owners(bytes(t).split(), length, gram)[0] for t in frame[raw]]
            yield pd.DataFrame({"fp": np.concatenate(found) if found else np.zeros(0, np.int64)})

    shared = written(plain.select(raw).mapInPandas(anchors, "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "anchors")
    filter_ = spark.sparkContext.broadcast(bit_filter(shared, "fp"))

    def stretches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = filter_.value
        for frame in frames(it):
            cols: dict[str, list] = {c: [] for c in (k1, k2, "fp", "first", "windows", "anchor", "hash", "stretch")}
            for a, b, t in zip(frame[k1], frame[k2], frame[raw]):
                words = bytes(t).split()
                fps, first, count, anchor = owners(words, length, gram)
                for i in np.flatnonzero(held.has(fps)):
                    text = b" ".join(words[first[i]:first[i] + count[i] + length - 1])
                    for c, x in zip(cols, (a, b, int(fps[i]), int(first[i]), int(count[i]), int(anchor[i] - first[i]), xxh3_64_intdigest(text) - (1 << 63), text)):
                        cols[c].append(x)
            yield pd.DataFrame(cols)

    found = written(plain.mapInPandas(stretches, f"`{k1}` long, `{k2}` long, fp long, first long, windows int, anchor int, hash long, stretch binary"), "stretches")
    different = found.groupBy("fp", "hash").agg(F.count(F.lit(1)).alias("times"), F.max("windows").alias("windows"), F.max("anchor").alias("anchor"), F.first("stretch").alias("stretch"))
    cover = repeated_windows(different, length, gram, halve=True).filter("mask != 0")
    own = found.select(k1, k2, "first", "fp", "hash").join(cover, ["fp", "hash"]).groupBy(k1, k2).agg(F.collect_set(F.struct("first", "mask")).alias(marks))

    fields = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n", T.LongType()), T.StructField("removed", T.LongType())])

    @F.pandas_udf(fields)
    def cut(texts: pd.Series, firsts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for t, starts, bits_ in zip(texts, firsts, masks):
            words = bytes(t).split()
            if starts is None or not len(starts):
                out.append((b" ".join(words).decode("utf-8", "replace"), len(words), 0))
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for s, m in zip(starts, bits_):
                m = int(m)
                while m:
                    k = (m & -m).bit_length() - 1
                    edge[s + k] += 1
                    edge[s + k + length] -= 1
                    m &= m - 1
            keep = np.cumsum(edge)[:-1] == 0
            out.append((b" ".join(w for w, y in zip(words, keep) if y).decode("utf-8", "replace"), len(words), int((~keep).sum())))
        return pd.DataFrame(out, columns=["kept", "n", "removed"])

    joined = docs.withColumns({k: F.xxhash64(F.lit(n), F.col(id_col), F.col(text_col)) for n, k in ((1, k1), (2, k2))}).join(own, [k1, k2], "left")
    done = joined.withColumn(raw, cut(text_bytes(F.col(text_col)), F.col(f"{marks}.first"), F.col(f"{marks}.mask")))
    return done.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(f"{raw}.kept").alias(kept_col), F.col(f"{raw}.n").alias(words_col),
        F.col(f"{raw}.removed").alias(removed_col))


def without_repeats(docs: DataFrame, **options: object) -> DataFrame:
    """docs with repeated windows cut out of the text; a text that loses nothing stays as it is. Columns as in docs;
    n_chars, if there, follows the text."""
    kept, n, removed = (fresh(docs, c) for c in ("__kept", "__words", "__removed"))
    out = remove_repeats(docs, kept_col=kept, words_col=n, removed_col=removed, **options)
    out = out.withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
