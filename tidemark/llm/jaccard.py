"""N-gram Jaccard join over prefix trees.

1. A text's set of word n-grams becomes sorted 64-bit keys in one global order, rare n-grams first: the order's frequency
   classes come from counters of bounded size over all texts. Texts of equal sets are one set from then on.
2. Two sets that link share one of their first n - ceil(t n) + 1 keys. These prefix keys are shuffled once, and rows of keys
   that more than one set has stay.
3. A key's sets meet its leader first, which gives classes; those of a key of more than PARTNERS sets meet a few more leaders
   while it holds several classes. Then, for each key that still holds several classes, pairs of
   different classes leave whose places in the key allow a link, were it their first common one. Of a key of more than PARTNERS
   sets they are found in tries: its sets are stored from that key on and walk them, partial overlaps of common paths are shared,
   and a subtree is cut when what remains of both sides is too short. Tries of whole sets decide all pairs. A link between
   different classes is found in this step, so the classes are exact; links inside a class are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from tidemark.llm.common import bit_filter, frames, fresh, text_bytes, written
from tidemark.llm.graph import components
from tidemark.llm.substrings import gram_hashes

WORDS = 5
THRESHOLD = 75  # percent
CELLS = 65_536  # counters of a slice
COUNTERS = (16, 24)  # counters of the frequency classes as powers of two: least and most
PARTNERS = 256  # sets of one trie; a key of no more gives its pairs without one
WINDOW = 64  # keys of a stretch
ROUNDS, LEADERS = 1, 4  # rounds in which the sets of a large key meet further leaders, and leaders of a round
PAIRS = "a long, b long, class_a long, class_b long"
CLASS_SHIFT, HASH_SHIFT = np.uint64(58), np.uint64(6)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """np.unique by a sort, which is several times faster than its hash table."""
    hashes = np.sort(hashes)
    return hashes[np.append(True, hashes[1:] != hashes[:-1])]


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Distinct hashes of the n-word shingles of a text in lower-case ASCII; with fewer words the whole sequence is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return gram_hashes(words, len(words)) ^ np.uint64(len(words))
    return distinct(gram_hashes(words, n))


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted keys: frequency class in the high bits, hash below."""
    cls = classes[(hashes & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((cls << CLASS_SHIFT) | (hashes >> HASH_SHIFT))


def prefix(size: int, percent: int = THRESHOLD) -> int:
    return size - -(-percent * size // 100) + 1


class Trie:
    """Ordered sets, or bounded stretches of them, with common beginnings stored once. A node is (keys, sets that end here,
    children, smallest size of a set below, most keys that a set below has from the root on, lowest rank below). `left`
    counts the keys of a set from its stretch's first on, `sizes` those of the whole set; a set that is stored whole needs
    neither. A walker meets sets of lower rank than its own."""

    def __init__(self, sets: list[np.ndarray], left: list[int] | None = None, sizes: list[int] | None = None, ranks: list[int] | None = None):
        self.ranks = ranks or [0] * len(sets)
        self.left = left or [len(s) for s in sets]
        self.sizes = sizes or self.left
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(sets[i].dtype.newbyteorder(">")).tobytes())
        self.root = self.node(sets, order, 0)

    def node(self, sets: list[np.ndarray], order: list[int], depth: int) -> tuple:
        first, last = sets[order[0]], sets[order[-1]]
        n = min(len(first), len(last)) - depth
        differ = np.flatnonzero(first[depth:depth + n] != last[depth:depth + n])  # order is sorted, so its ends differ first
        end = depth + (int(differ[0]) if len(differ) else n)
        ends = [i for i in order if len(sets[i]) == end]
        children, rest, at = [], [i for i in order if len(sets[i]) > end], 0
        while at < len(rest):
            to = at
            while to < len(rest) and sets[rest[to]][end] == sets[rest[at]][end]:
                to += 1
            children.append(self.node(sets, rest[at:to], end))
            at = to
        return first[depth:end], ends, children, min([self.sizes[i] for i in order]), max([self.left[i] for i in order]), min([self.ranks[i] for i in order])

    def below(self, node: tuple) -> list[int]:
        out, stack = [], [node]
        while stack:
            _, ends, children, *_ = stack.pop()
            out += ends
            stack += children
        return out

    def linked(self, x: np.ndarray, percent: int, left: int | None = None, size: int | None = None, rank: int = 1) -> list[int]:
        """Numbers of the sets of a rank below `rank` whose overlap with x can be at least percent of the union: of whole
        sets, those whose overlap is. A stretch says nothing of what lies behind it, so there the shorter rest counts as
        shared."""
        left = len(x) if left is None else left
        size = left if size is None else size
        found = []
        stack = [(self.root, 0, 0, left)]
        while stack:
            (keys, ends, children, low, high, least), depth, overlap, rest = node = stack.pop()
            # all that can still be shared: what is left of x, and of the longest set below
            if least >= rank or (100 + percent) * (overlap + min(rest, high - depth)) < percent * (size + low):
                continue
            inside = len(keys)
            if inside:
                at = x.searchsorted(keys)
                if at[-1] < len(x):
                    overlap += int(np.count_nonzero(x[at] == keys))
                    rest = left - int(at[-1])
                else:  # only the keys up to the last one of x can be compared
                    inside = int(at.searchsorted(len(x)))
                    overlap += int(np.count_nonzero(x[at[:inside]] == keys[:inside]))
                    rest = left - len(x)
            past = inside < len(keys)
            depth += inside
            if (100 + percent) * (overlap + min(rest, high - depth)) < percent * (size + low):
                continue
            near = self.below(node[0]) if past else ends
            found += [i for i in near if self.ranks[i] < rank
                      and (100 + percent) * (overlap + min(rest, self.left[i] - depth)) >= percent * (size + self.sizes[i])]
            if not past:
                stack += [(child, depth, overlap, rest) for child in children]
        return found


def frequency_classes(hashed: DataFrame, total: int) -> np.ndarray:
    """log2 classes of the counts of n-grams over all texts, in 2^16 to 2^24 shared counters. Tasks send their counters in
    compressed slices, which are added up slice by slice as they arrive."""
    bits = max(COUNTERS[0], min(COUNTERS[1], max(1, total // 8).bit_length()))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for frame in frames(it):
            slots = np.sort(np.concatenate([np.zeros(0, np.uint64), *[shingles(bytes(t)) for t in frame["raw"]]]) & np.uint64((1 << bits) - 1))
            ends = np.flatnonzero(np.append(slots[1:] != slots[:-1], len(slots) > 0))
            counts[slots[ends].astype(np.int64)] += np.diff(ends, prepend=-1).astype(np.uint32)
        for k in range(len(counts) // CELLS):
            part = counts[k * CELLS:(k + 1) * CELLS]
            if (most := part.max()) > 0:
                part = part.astype(np.min_scalar_type(most))  # a slice is of bytes where its counts are small
                yield pd.DataFrame({"slice": [k], "width": [part.itemsize], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = -1, np.zeros(CELLS, dtype=np.int64)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"slice": [at], "classes": [np.log2(np.maximum(sums, 1)).astype(np.uint8).tobytes()]})

        for frame in it:
            for k, width, data in zip(frame["slice"], frame["width"], frame["counts"]):
                if k != at and at >= 0:
                    yield done()
                    sums = np.zeros(CELLS, dtype=np.int64)
                at = int(k)
                sums += np.frombuffer(zlib.decompress(bytes(data)), dtype=f"u{width}")
        if at >= 0:
            yield done()

    slices = hashed.mapInPandas(count, "slice int, width int, counts binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in slices.mapInPandas(add, "slice int, classes binary").collect():  # at most 2^24 bytes
        out[r.slice * CELLS:(r.slice + 1) * CELLS] = np.frombuffer(r.classes, dtype=np.uint8)
    return out


def set_ids(raw: pd.Series) -> tuple[list[int], list[bytes | None]]:
    """Size and 128-bit name of each text's set."""
    sizes, names = [], []
    for t in raw:
        s = shingles(bytes(t))
        sizes.append(len(s))
        names.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
    return sizes, names


def set_of(text_col: str) -> object:
    """Column of (n, sid): set size and name of a text."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("sid", T.BinaryType())])

    @F.pandas_udf(kind)
    def named(raw: pd.Series) -> pd.DataFrame:
        sizes, names = set_ids(raw)
        return pd.DataFrame({"n": sizes, "sid": pd.Series(names, dtype=object)})

    return named(text_bytes(F.col(text_col)))


def stretches(it: Iterator[pd.DataFrame], by: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by `by`, a group at a time. Groups must be of bounded size."""
    rest = None
    for frame in it:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        new = np.zeros(len(frame), dtype=bool)
        for c in by:
            v = frame[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        cols = {c: frame[c].to_numpy() for c in frame.columns}
        for at, to in zip(cuts, cuts[1:]):
            yield {c: v[at:to] for c, v in cols.items()}
        rest = frame.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}


def classes_of_sets(texts: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another set. texts: uid, n, raw, one row a set."""
    spark = texts.sparkSession
    total = texts.agg(F.sum("n")).first()[0] or 0
    classes = spark.sparkContext.broadcast(frequency_classes(texts, total))

    def prefixes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            out = [np.zeros(0, np.uint64)]
            for t in frame["raw"]:
                s = shingles(bytes(t))
                out.append(ordered(s, classes.value)[:prefix(len(s), percent)])
            sizes = [len(x) for x in out[1:]]
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in [0, *sizes]])
            keys = np.concatenate(out).view(np.int64)
            yield pd.DataFrame({"key": keys, "uid": np.repeat(frame["uid"].to_numpy(), sizes), "n": np.repeat(frame["n"].to_numpy(), sizes), "at": at})

    def met(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of keys that more than one set has, with the key's leader: its first row. Only the last row seen and the
        leader are kept between frames, whatever a key's length."""
        held, lead = None, None
        for frame in it:
            key = frame["key"].to_numpy()
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
                key = frame["key"].to_numpy()
            start = np.ones(len(key), dtype=bool)
            start[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            cols = {f"{c}_": frame[c].to_numpy()[first] for c in ("uid", "n")}
            if lead is not None and lead[0] == key[0]:  # the leader of the first key may lie in an earlier frame
                old = first == 0
                for c, v in zip(("uid_", "n_"), lead[1:]):
                    cols[c][old] = v
            frame = frame.assign(**cols)
            # a row alone in its key goes; the last row waits for the next frame
            alone = (frame["uid"] == frame["uid_"]).to_numpy() & np.append(start[1:], True)
            lead = (key[-1], cols["uid_"][-1], cols["n_"][-1])
            held = frame.iloc[-1:][["key", "uid", "n", "at"]]
            yield frame.iloc[:-1][~alone[:-1]]
        if held is not None and lead[1] != held["uid"].iloc[0]:
            yield held.assign(uid_=lead[1], n_=lead[2])

    # the set that a key stands first in leads it: copies carry their own rare keys in front of those of their source
    keyed = texts.mapInPandas(prefixes, "key long, uid long, n int, at int").repartition("key").sortWithinPartitions("key", "at", "uid")
    held = written(keyed.mapInPandas(met, "key long, uid long, n int, at int, uid_ long, n_ int"), "members")

    sizes = f"100 * n >= {percent} * n_ AND 100 * n_ >= {percent} * n"
    size = lambda n: f"({n} - CAST(ceil({percent} * {n} / 100) AS INT) + 1)"
    # links to leaders, where the shared prefix keys allow them; a pair that is left out here is met again in the tries
    first = held.filter(f"uid != uid_ AND {sizes}").groupBy(F.col("uid_").alias("a"), F.col("uid").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("n_").alias("n_"))
    first = first.filter(f"{100 + percent} * (c + least(n - {size('n')}, n_ - {size('n_')})) >= {percent} * (n + n_)").select("a", "b")
    first = written(first, "pairs")
    edges = written(verified(first, texts, classes, percent), "links")
    labels = components(edges)

    named = held.join(labels, held["uid"] == labels["node"], "left").select("key", "uid", "n", "at", F.coalesce("component", "uid").alias("class"))
    named = written(named, "classed")
    open_ = of_several_classes(named)
    second = side_by_side(open_.filter("blocks = 1"), percent)
    large = open_.filter("blocks > 1")
    for k in range(ROUNDS):  # a leader that few sets link with leaves a large key's sets apart, and its pairs would be a square
        if not large.limit(1).count():
            break
        drawn = [F.min_by(F.struct("uid", "n", "class"), F.xxhash64("uid", F.lit(LEADERS * k + i))) for i in range(LEADERS)]
        lead = large.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("lead"))
        some = large.join(lead, "key").withColumn("lead", F.explode("lead")).select(
            "n", F.col("lead.n").alias("n_"), F.col("lead.uid").alias("a"), F.col("uid").alias("b"), F.col("lead.class").alias("class_a"),
            F.col("class").alias("class_b"))
        some = written(some.filter(f"class_a != class_b AND {sizes}").select("a", "b", "class_a", "class_b").distinct(), "pairs")
        links = linking(some, texts, classes, percent)
        edges = edges.union(links)
        to = components(links)
        large = of_several_classes(joined_classes(large.drop("blocks"), to, "class"))
        second = joined_classes(joined_classes(second, to, "class_a"), to, "class_b").filter("class_a != class_b")
    if large.limit(1).count():
        second = second.union(in_tries(large, texts, classes, percent)).distinct()
    out = components(edges.union(class_links(written(second, "pairs"), texts, classes, percent)))
    classes.unpersist()
    return out


def of_several_classes(named: DataFrame) -> DataFrame:
    """Rows of keys whose sets are of several classes, with the key's number of blocks of PARTNERS sets. named: key, uid, n, at,
    class."""
    mixed = named.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("c"))
    mixed = mixed.filter("lo != hi").select("key", F.ceil(F.col("c") / PARTNERS).cast("int").alias("blocks"))
    return written(named.join(mixed, "key"), "open")


def joined_classes(rows: DataFrame, to: DataFrame, name: str) -> DataFrame:
    """rows with the classes in column `name` replaced by what they have become. to: node, component."""
    rows = rows.join(to, rows[name] == to["node"], "left").withColumn(name, F.coalesce("component", name))
    return rows.drop("node", "component")


def linking(pairs: DataFrame, texts: DataFrame, classes: object, percent: int) -> DataFrame:
    """(a, b) of the classes of pairs of sets that link. pairs: a, b, class_a, class_b."""
    found = verified(pairs.select("a", "b"), texts, classes, percent)
    found = pairs.join(found, ["a", "b"], "left_semi")
    return written(found.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "links")


def class_links(pairs: DataFrame, texts: DataFrame, classes: object, percent: int) -> DataFrame:
    """(a, b) of classes that a pair of their sets links. pairs: a, b, class_a, class_b. A set meets one set of each other class
    first; the other pairs are decided only where that leaves their classes apart, so large classes that link are no square."""
    between = ["class_a", "class_b"]
    one = written(pairs.groupBy("a", *between).agg(F.min("b").alias("b")), "pairs")
    links = linking(one, texts, classes, percent)
    joined = components(links)
    apart = pairs.select(*between).distinct()
    for c in between:
        to = joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
        apart = apart.join(to, c, "left").withColumn(f"{c}_", F.coalesce(f"{c}_", c))
    rest = pairs.join(apart.filter("class_a_ != class_b_").select(*between), between, "left_semi").join(one, ["a", "b"], "left_anti")
    rest = written(rest, "pairs")
    if rest.limit(1).count():
        links = links.union(linking(rest, texts, classes, percent))
    return links


def sets_of(texts: DataFrame, uids: DataFrame, classes: object, keys: object) -> DataFrame:
    """(uid, keys binary) of the sets in uids: keys(ordered set) of each. Only their texts are hashed."""
    wanted = texts.sparkSession.sparkContext.broadcast(bit_filter(uids.select(F.xxhash64("uid").alias("h")), "h"))
    cand = texts.select("uid", "raw", F.xxhash64("uid").alias("h"))

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            frame = frame[wanted.value.has(frame["h"].to_numpy())]
            data = [keys(ordered(shingles(bytes(t)), classes.value)).tobytes() for t in frame["raw"]]
            yield pd.DataFrame({"uid": frame["uid"].to_numpy(), "keys": pd.Series(data, dtype=object)})

    out = written(cand.mapInPandas(sets, "uid long, keys binary"), "sets")
    wanted.unpersist()
    return out


def side_by_side(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b, class_a, class_b) of sets of different classes that share a key of at most PARTNERS sets and may link: were it
    their first common key, nothing before it is shared, and what is left of each from it on must suffice. open_: key, uid, n,
    at, class."""

    def able(frame: pd.DataFrame) -> pd.DataFrame:
        key, uid, n, at, cls = (frame[c].to_numpy() for c in ("key", "uid", "n", "at", "class"))
        n = n.astype(np.int64)
        left = n - at
        ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first = np.arange(len(key))
        for step in range(1, len(key)):  # rows of a key lie side by side: each meets the one `step` rows on
            first = first[first + step < len(key)]
            first = first[key[first] == key[first + step]]
            if not len(first):
                break
            second = first + step
            fits = (100 + percent) * np.minimum(left[first], left[second]) >= percent * (n[first] + n[second])
            fits &= cls[first] != cls[second]
            ones.append(first[fits])
            others.append(second[fits])
        return class_pairs(uid, cls, np.concatenate(ones), np.concatenate(others))

    def pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in it:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            key = frame["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next frame
            yield able(frame.iloc[:cut])
            rest = frame.iloc[cut:]
        if rest is not None:
            yield able(rest)

    rows = open_.select("key", "uid", "n", "at", "class").repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(pairs, PAIRS).distinct()


def class_pairs(uid: np.ndarray, cls: np.ndarray, one: np.ndarray, other: np.ndarray) -> pd.DataFrame:
    """Distinct pairs of the rows `one` and `other`, the smaller uid first."""
    swap = uid[one] > uid[other]
    a, b = np.where(swap, other, one), np.where(swap, one, other)
    return pd.DataFrame({"a": uid[a], "b": uid[b], "class_a": cls[a], "class_b": cls[b]}).drop_duplicates()


def in_tries(open_: DataFrame, texts: DataFrame, classes: object, percent: int) -> DataFrame:
    """(a, b, class_a, class_b) of sets of different classes that meet in a key and may link. open_: key, uid, n, at, class,
    blocks.

    A key's sets are taken from that key on, and a pair that shares a key before it is judged there alone, so it is found once
    however many keys it shares. Stretches of WINDOW keys (high halves) are stored in a trie of about PARTNERS
    sets, the sets of each block walk it. A hot key has many blocks and a group for each two of them.
    """
    def halves(keys: np.ndarray) -> np.ndarray:
        """The keys of the prefix, then the high halves of them and of WINDOW more."""
        to = prefix(len(keys), percent)
        return np.concatenate([keys[:to].view(np.uint32), (keys[:to + WINDOW] >> np.uint64(32)).astype(np.uint32)])

    need = sets_of(texts, open_.select("uid").distinct(), classes, halves)
    rows = open_.join(need, "uid").select(
        "key", "uid", "n", "at", "class", "blocks", F.expr("substring(keys, 1, 8 * at)").alias("before"),
        F.expr(f"substring(keys, 8 * (n - CAST(ceil({percent} * n / 100) AS INT) + 1) + 4 * at + 1, {4 * WINDOW})").alias("part"),
        F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("o", other).select(
        "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "uid", "n", "at", "class", "before", "part")

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in stretches(it, ["key", "i", "j"]):
            uid, n, at, cls = (g[c] for c in ("uid", "n", "at", "class"))
            parts = [np.frombuffer(bytes(p), dtype=np.uint32) for p in g["part"]]
            before = [set(np.frombuffer(bytes(p), dtype=np.uint64).tolist()) for p in g["before"]]
            mine = g["own"] == g["i"]
            same = g["i"][0] == g["j"][0]
            # pairs of different classes whose keys from here on suffice; the largest class has the lowest rank, so its sets don't walk
            _, number, counts = np.unique(cls, return_inverse=True, return_counts=True)
            rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")[number]
            left = n - at
            able = (100 + percent) * np.minimum.outer(left, left).astype(np.int64) >= percent * np.add.outer(n, n).astype(np.int64)
            able &= np.less.outer(rank, rank)  # [stored, walking]
            ones: list[int] = []
            others: list[int] = []
            for stored, walking in ((mine, mine),) if same else ((mine, ~mine), (~mine, mine)):
                part = able & np.logical_and.outer(stored, walking)
                inner, walkers = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                if not len(inner):
                    continue
                trie = Trie([parts[i] for i in inner], left[inner].tolist(), n[inner].tolist(), rank[inner].tolist())
                for x in walkers:
                    hit = inner[trie.linked(parts[x], percent, int(left[x]), int(n[x]), int(rank[x]))].tolist()
                    hit = [i for i in hit if before[x].isdisjoint(before[i])]
                    ones += [x] * len(hit)
                    others += hit
            if ones:
                yield class_pairs(uid, cls, np.array(ones), np.array(others))

    sorted_ = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInPandas(walk, PAIRS).distinct()


def verified(pairs: DataFrame, texts: DataFrame, classes: object, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link, by tries of whole sets: about PARTNERS partners of a stored, a's set walks."""
    names = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    made = sets_of(texts, names, classes, lambda k: k)
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("tries"))
    dealt = pairs.join(many, "a").withColumn("trie", F.pmod(F.xxhash64("b"), F.col("tries")).cast("int"))
    partners = dealt.join(made, dealt["b"] == made["uid"]).select("a", "trie", "b", "keys")
    walkers = many.withColumn("trie", F.explode(F.sequence(F.lit(0), F.col("tries") - 1))).join(made, F.col("a") == made["uid"]).select("a", "trie", F.col("a").alias("b"), "keys")

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in stretches(it, ["a", "trie"]):
            own = g["a"] == g["b"]
            if own.all() or not own.any():
                continue
            sets = [np.frombuffer(bytes(k), dtype=np.uint64) for k in g["keys"]]
            others = np.flatnonzero(~own)
            found = others[Trie([sets[i] for i in others]).linked(sets[int(own.argmax())], percent)]
            if len(found):
                yield pd.DataFrame({"a": g["a"][found], "b": g["b"][found]})

    both = partners.unionByName(walkers).repartition("a", "trie").sortWithinPartitions("a", "trie")
    return both.mapInPandas(walk, "a long, b long")


def jaccard_classes(docs: DataFrame, percent: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, sid, class, component_id) of every row: its set's size and name, the name of its class, and the
    smallest id reachable over links of at least percent similarity, its own included. A null or empty text has no set and
    links with nothing; rows of equal sets link; a null id counts as larger than any other. Every text is read whole. Classes
    may have the same smallest id (ids that are null or repeated), but not the same name."""
    named = docs.select(F.col(id_col), set_of(text_col).alias("s"), text_bytes(F.col(text_col)).alias("raw"))
    named = written(named.select(id_col, F.col("s.n").alias("n_shingles"), F.col("s.sid").alias("sid"), "raw"), "set-names")
    by_set = classes_of_names(named, percent, id_col)
    named = named.select(id_col, "n_shingles", "sid")
    return named.join(by_set, "sid", "left").select(id_col, "n_shingles", "sid", "class", F.coalesce("component_id", id_col).alias("component_id"))


def classes_of_names(named: DataFrame, percent: int, id_col: str) -> DataFrame:
    """(sid, class, component_id) of the sets of named (id_col, n_shingles, sid, raw), a table that is read several times."""
    # one text a set, numbered: from here on a set is a long
    texts = named.filter("sid IS NOT NULL").groupBy("sid").agg(F.first("n_shingles").cast("int").alias("n"), F.first("raw").alias("raw"))
    texts = written(texts.withColumn("uid", F.monotonically_increasing_id()), "set-texts")
    classes = classes_of_sets(texts.select("uid", "n", "raw"), percent)
    low = named.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(id_col).alias("low"))
    least = low.join(texts.select("sid", "uid"), "sid")
    least = least.join(classes, least["uid"] == classes["node"], "left").select("sid", "low", F.coalesce("component", "uid").alias("class"))
    least = written(least, "class-names")
    best = least.groupBy("class").agg(F.min("low").alias("component_id"))
    return least.join(best, "class").select("sid", "class", "component_id")


def one_of_each(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each class the row of the smallest doc_id stays (of rows that repeat it, one; a
    null id is the largest). Rows without a set stay. Columns as in docs."""
    key, n = fresh(docs, "__sid"), fresh(docs, "__n")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # written with their names: a filter over a Python column would work it out once more, in workers of its own
    named = docs.withColumn(key, set_of("text")).select(*cols, F.col(f"{key}.n").alias(n), F.col(f"{key}.sid").alias(key))
    named = written(named, "set-names")
    sets = named.select("doc_id", F.col(n).alias("n_shingles"), F.col(key).alias("sid"), text_bytes(F.col("text")).alias("raw"))
    found = sets.select("doc_id", "sid").join(classes_of_names(sets, percent, "doc_id"), "sid")
    # one row a class: its smallest id with the name of one of its sets
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("first")
    kept = found.groupBy("class").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.sid").alias("__set"))
    with_set = named.filter(F.col(key).isNotNull()).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__set")), "left_semi")
    return with_set.dropDuplicates(["doc_id", key]).select(*cols).unionByName(named.filter(F.col(key).isNull()).select(*cols))
