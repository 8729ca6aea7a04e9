"""Merkle manifest of a table of documents: a tree per source, and a tree over the sources' roots.

Leaves are placed by bitmap rank. Each source has a bitmap of its doc_ids, kept as the non-zero 64-bit words of containers of
4,096 ids and merged with bit_or; popcount directories count the rows before a word, before a container, and before every
group of 4,096 containers, of 4,096 such groups, and so on. A leaf asks its container for its rank, and that is its place:
no source is sorted. Leaves then meet in slot arrays keyed by (source, place div 243), which reduce five levels at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import places, written

ARITY = 3
LEVELS = 5
SLOTS = ARITY**LEVELS  # nodes of a slot array
BITS = 12  # ids of a container, and containers of a group, as a power of 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "r"  # group of the sources' roots; those of sources begin with another letter
MOST_BROADCAST = 100_000  # directory rows (some 700 bytes each at most) or sources broadcast; beyond, a shuffle join


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Lowercase hex sha256 of the fields one after another: `-` for null, else UTF-8 byte count, `:`, value."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(v) for v in fields.values()]).cast("binary"), 256)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left join right; right is broadcast if its counted rows are few."""
    return left.join(F.broadcast(right) if rows is not None and rows <= MOST_BROADCAST else right, on, how)


def leaf_places(leaves: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered, n) with place, the rank of the first of the n rows in g by (doc_id null first, leaf).

    leaves: one row for each different (g, doc_id, leaf), n counts its rows.
    """
    # ids in unsigned order, so that shifts keep it
    key = F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    rows = leaves.withColumns({"box": F.shiftrightunsigned(key, BITS), "word": F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(63)), "bit": key.bitwiseAND(F.lit(63)).cast("int")})
    left = lambda value, bit: F.call_function("shiftleft", F.lit(value).cast("long"), bit)
    with_id = rows.filter("doc_id IS NOT NULL")

    # ids with several rows count for their number beyond the bitmap; the order among them is that of the leaves
    ids = with_id.groupBy("g", "box", "word", "bit", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    words = ids.groupBy("g", "box", "word").agg(
        F.bit_or(left(1, F.col("bit"))).alias("bits"), F.sum("n").alias("n"), F.max("kinds").alias("kinds"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))).alias("more"))
    running = F.sum("n").over(Window.partitionBy("g", "box").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("before", F.coalesce(running, F.lit(0)))
    boxes = written(words.groupBy("g", "box").agg(
        F.sum("n").alias("n"), F.max("kinds").alias("kinds"), F.sort_array(F.collect_list(F.struct("word", "bits", "before", "more"))).alias("words")), "bitmaps")
    nulls = rows.filter("doc_id IS NULL").groupBy("g").agg(F.sum("n").alias("nulls"))
    starts = group_starts(boxes.select("g", F.col("box").alias("k0"), "n"))
    starts = written(starts.join(nulls, "g", "left").select("g", F.col("k0").alias("box"), (F.col("start") + F.coalesce("nulls", F.lit(0))).alias("start")), "directory")
    total = boxes.agg(F.count(F.lit(1)).alias("n"), F.max("kinds").alias("kinds")).first()
    directory = joined(boxes, starts, ["g", "box"]).select("g", "box", "start", "words")

    word = F.filter("words", lambda w: w["word"] == F.col("word"))[0]
    below = word["bits"].bitwiseAND(F.bitwise_not(left(-1, F.col("bit"))))
    more = F.aggregate(F.filter(word["more"], lambda m: m["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda acc, m: acc + m["more"])
    ranked = joined(with_id, directory, ["g", "box"], rows=total.n).select(
        *leaves.columns, (F.col("start") + word["before"] + F.bit_count(below) + more).alias("place"))
    none = rows.filter("doc_id IS NULL").select(*leaves.columns, F.lit(0).cast("long").alias("place"))
    if (total.kinds or 0) <= 1 and none.isEmpty():
        return ranked
    # different rows of one id, or of none, follow each other by their leaves
    several = ranked.groupBy("g", "doc_id").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds")
    tied = none.unionByName(ranked.join(several, ["g", "doc_id"]).select(ranked.columns))
    nth = places(tied, ["g", "doc_id"], [F.col("leaf")], "nth")
    # rows before it: a running sum over blocks of nth, in two levels
    block = nth.withColumn("block", F.floor(F.col("nth") / 4096))
    sums = block.groupBy("g", "doc_id", "block").agg(F.sum("n").alias("sum"))
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("g", "doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("g", "doc_id", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("g").alias("sg"), F.col("doc_id").alias("sd"), F.col("block").alias("sb"), earlier.alias("earlier"))
    at = block.withColumn("own", own)
    at = at.join(sums, at["g"].eqNullSafe(F.col("sg")) & at["doc_id"].eqNullSafe(F.col("sd")) & (at["block"] == F.col("sb")))
    tied = at.select(*leaves.columns, (F.col("place") + F.col("earlier") + F.col("own")).alias("place"))
    return ranked.join(several, ["g", "doc_id"], "left_anti").select(ranked.columns).unionByName(tied)


def group_starts(counts: DataFrame) -> DataFrame:
    """(g, k0, n) with start, the sum of n over smaller k0 of g. Each level of the directory counts groups of 4,096 keys of
    the level below and adds up inside them, so no task holds more than that of one source, however sparse the ids are."""
    levels, top = [], (64 - BITS) // BITS
    for level in range(top + 1):
        this = counts if level == 0 else levels[-1].groupBy("g", f"k{level}").agg(F.sum("n").alias("n"))
        levels.append(this.withColumn(f"k{level + 1}", F.shiftrightunsigned(f"k{level}", BITS)))
    start = None
    for level in range(top, -1, -1):
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("g", f"k{level + 1}").orderBy(f"k{level}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        this = levels[level].withColumn("start", inside)
        if start is not None:
            above = start.select("g", f"k{level + 1}", F.col("start").alias("above"))
            this = this.join(above, ["g", f"k{level + 1}"]).withColumn("start", F.col("start") + F.col("above"))
        start = this.select("g", f"k{level}", "n", "start")
    return start


def height(nodes: Column) -> Column:
    """Levels that a slot array reduces where its tree has so many nodes: up to LEVELS, none for a lone node."""
    return sum((F.when(nodes > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and those of each level above: runs of ARITY become their hash."""
    rows = [nodes]
    for _ in range(levels):
        last = rows[-1]
        rows.append([hashlib.sha256("".join(last[i:i + ARITY]).encode()).hexdigest() for i in range(0, len(last), ARITY)])
    return rows


def path(rows: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(siblings to the left, siblings to the right) of the node at a place, level by level."""
    out = []
    for level in rows[:-1]:
        run = at - at % ARITY
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + ARITY])))
        at //= ARITY
    return out


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def arrays(nodes: DataFrame, members: list[str]) -> DataFrame:
    """Slot arrays (g, total, block, slots) of nodes (g, total, place, members...)."""
    return nodes.groupBy("g", "total", F.floor(F.col("place") / SLOTS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.pmod("place", F.lit(SLOTS)).cast("int").alias("slot"), *members))).alias("slots"))


def block_roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        top = [reduced([s["node"] for s in slots], n)[-1][0] for slots, n in zip(f["slots"], f["levels"])]
        yield f[["g", "total", "place"]].assign(node=top)


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written slot arrays of every round, and (g, node), the root of each tree. nodes: (g, total, place, node, ...)."""
    rounds, members = [], [c for c in nodes.columns if c not in ("g", "total", "place")]
    while True:
        rounds.append(written(arrays(nodes, members), "slots"))
        up = rounds[-1].select("g", "total", F.col("block").alias("place"), "slots", height(F.col("total")).alias("levels"))
        up = up.mapInPandas(block_roots, "g string, total long, place long, node string")
        nodes, members = up.withColumn("total", F.ceil(F.col("total") / SLOTS)), ["node"]
        most = rounds[-1].agg(F.max("total")).first()[0] or 0
        if most <= SLOTS:
            return rounds, written(up.select("g", "node"), "roots")


STEPS = "array<struct<left:string,right:string>>"


def child_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path of every node of the slot arrays to the end of `above`, the path of the array's own root."""
    for f in frames:
        for g, block, slots, n, above in zip(f["g"], f["block"], f["slots"], f["levels"], f["above"]):
            rows, rest = reduced([s["node"] for s in slots], n), [(s["left"], s["right"]) for s in above]
            steps = [[{"left": a, "right": b} for a, b in path(rows, k) + rest] for k in range(len(slots))]
            yield pd.DataFrame({"g": g, "block": [int(block) * SLOTS + k for k in range(len(slots))], "above": steps})


def upper_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, block, above) for the slot arrays of the first round. above: (g, above), the path of each tree's root."""
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for table in reversed(rounds[1:]):
        wide = table.select("g", "block", "slots", height(F.col("total")).alias("levels")).join(paths, ["g", "block"])
        paths = written(wide.mapInPandas(child_paths, f"g string, block long, above {STEPS}"), "paths")
    return paths


def proofs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for g, slots, n, above in zip(f["g"], f["slots"], f["levels"], f["above"]):
            rows, rest = reduced([s["node"] for s in slots], n), [(s["left"], s["right"]) for s in above]
            out = []
            for k, s in enumerate(slots):
                steps = path(rows, k) + rest
                out.append((g, s["doc_id"], s["node"], hashlib.sha256("".join(a + b for a, b in steps).encode()).hexdigest(), folded(s["tampered"] or s["node"], steps)))
            yield pd.DataFrame(out, columns=["g", "doc_id", "leaf", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of docs.

    Every row is a leaf of its source's tree, by (doc_id null first, leaf); rows alike in all five fields follow each other
    and each has its own place. A null source is a source of its own and comes first, an empty one next. tampered_text:
    the text that folded_root is recomputed from, by default the text itself; proofs and roots are those of the original.
    Texts are taken whole, other columns play no role. An empty table gives an empty one. What moves is ids and digests.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = leaf_hash({**fields, "text": tampered_text}) if tampered_text is not None else None
    leaf = leaf_hash(fields)
    g = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), leaf.alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("tampered"))
    # a digest that tampering leaves as it is needn't travel
    rows = rows.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.unhex("tampered"))).withColumn("leaf", F.unhex("leaf"))
    leaves = written(rows.groupBy("g", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n")), "leaves")

    totals = written(leaves.groupBy("g").agg(F.sum("n").alias("total"), F.max("n").alias("same")), "totals")
    few = totals.agg(F.count(F.lit(1)).alias("n"), F.max("same").alias("same")).first()
    placed = leaf_places(leaves)
    if (few.same or 0) > 1:
        # copies of a row are spread before they are made, so that a row that repeats often is no single task
        spread = placed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long")))).repartition("g", "doc_id", "leaf", "first")
        each = spread.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + 4095, F.col("n") - 1))))
        placed = each.withColumn("place", F.col("place") + F.col("copy"))
    nodes = joined(placed, totals.select("g", "total"), ["g"], rows=few.n).select(
        "g", "total", "place", F.lower(F.hex("leaf")).alias("node"), F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.hex("tampered")).alias("tampered"))
    rounds, subroots = tree(nodes)

    # sources in order: null ("n") before all others ("s..."), these by their bytes
    tops = places(subroots, [], [F.col("g")]).select(F.lit(TOP).alias("g"), F.lit(few.n).cast("long").alias("total"), "place", "node", F.col("g").alias("source_g"))
    tops = written(tops, "tops")
    top_rounds, top = tree(tops.drop("source_g"))
    ends = upper_paths([None, *top_rounds], top.select("g", F.array().cast(STEPS).alias("above")))
    sources = tops.join(ends.select(F.col("block").alias("place"), "above"), "place").select(F.col("source_g").alias("g"), F.col("node").alias("subroot"), "above")
    sources = written(sources, "sources")
    root = top.first()

    wide = rounds[0].select("g", "block", "slots", height(F.col("total")).alias("levels")).join(upper_paths(rounds, sources.select("g", "above")), ["g", "block"])
    done = wide.mapInPandas(proofs, "g string, doc_id string, leaf string, proof_sha256 string, folded_root string")
    done = joined(done, sources.select("g", "subroot"), ["g"], rows=few.n)
    whole = F.lit(root.node if root else None).cast("string")
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30)).alias("source"), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == whole).alias("verified"))
