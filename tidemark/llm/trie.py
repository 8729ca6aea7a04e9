"""Prefix trie of conversations with subtree totals by parallel tree contraction.

Turns are placed by a range sort and become digests; a node's id is the xor of the digests of (place, turn) up to its depth,
so prefixes are running sums and never strings. Totals come from rounds of rake (childless nodes give their sum to the
parent) and compress (a node with one child is taken out of its chain), each a few joins over what is left; nodes taken out
are then put back, last round first, and get the total of the child they had.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import places, written

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 1_024  # turns of a running sum in one task
ENDS = 12  # conv_ids of a range of 2^12 are joined to a text in one task
ROOT = "0" * 32
MOST_ROUNDS = 200  # a safeguard: rounds grow with the logarithm of the nodes


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv, at, sha, words) of every turn of a non-null conv_id; at from 1, by (turn null first, digest of role and text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", sha.alias("sha"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    put = places(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("sha")], "at")
    return written(put.select("conv", (F.col("at") + 1).alias("at"), "sha", "words"), "turns")


def shared_start(placed: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv, at, sha, words, last) and every conversation (conv, n) with its number of them.

    Of conversation c the first h = crc32(c) % most turns are those of conversation c - c % family, as far as it has them;
    c's own turns after its first h follow.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    givers = placed.filter((F.col("conv") % family == 0) & (F.col("at") < most)).select(F.col("conv").alias("giver"), "at", "sha", "words")
    given = givers.groupBy("giver").agg(F.max("at").alias("has"))
    own = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("size")).withColumns({"h": h, "giver": F.col("conv") - F.col("conv") % family})
    own = own.join(given, "giver", "left").withColumn("start", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
    convs = written(own.select("conv", "giver", "h", "start", (F.col("start") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    taken = convs.join(givers, "giver").filter("at <= h").select("conv", "at", "sha", "words", "n")
    after = placed.join(convs, "conv").filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("start")).alias("at"), "sha", "words", "n")
    rows = taken.unionByName(after)
    return rows.select("conv", "at", "sha", "words", (F.col("at") == F.col("n")).alias("last")), convs.select("conv", "n")


def prefix_ids(rows: DataFrame) -> DataFrame:
    """rows with id and parent_id: 128-bit names of the sequence up to the row and of that before it. A hot conversation
    is summed in blocks of BLOCK turns."""
    lanes = rows.withColumns({"a": F.xxhash64("at", "sha"), "b": F.xxhash64("sha", "at", F.lit("b")), "block": F.floor((F.col("at") - 1) / BLOCK)})
    inside = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    longer = lanes.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    # only conversations beyond one block have a sum to carry
    carried = longer.select("conv", "block", F.bit_xor("a").over(earlier).alias("ca"), F.bit_xor("b").over(earlier).alias("cb")).filter("block > 0")
    run = lanes.withColumns({"ra": F.bit_xor("a").over(inside), "rb": F.bit_xor("b").over(inside)}).join(carried, ["conv", "block"], "left")
    whole = lambda own, carry: F.col(own).bitwiseXOR(F.coalesce(F.col(carry), F.lit(0).cast("long")))
    x, y = whole("ra", "ca"), whole("rb", "cb")
    name = lambda a, b: F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))
    return run.select(*rows.columns, name(x, y).alias("id"), name(x.bitwiseXOR(F.col("a")), y.bitwiseXOR(F.col("b"))).alias("parent_id"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes at which conversations end; ends: (id, conv). Ids are joined to texts by ranges of conv;
    of a node with several ranges the texts stream through one hash in order, in constant memory."""
    chunk = ends.groupBy("id", F.shiftright("conv", ENDS).alias("range")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
    chunk = chunk.select("id", "range", F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("part"))
    whole = written(chunk, "ends")
    several = whole.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    one = whole.join(several, "id", "left_anti").select("id", F.sha2(F.col("part").cast("binary"), 256).alias("ends_sha256"))
    more = whole.join(several, "id").repartition("id").sortWithinPartitions("id", "range").select("id", "part")
    return one.unionByName(more.mapInPandas(streamed_digests, "id string, ends_sha256 string"))


def streamed_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, state = None, None
    for frame in frames:
        done = []
        for name, part in zip(frame["id"], frame["part"]):
            if name != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = name, hashlib.sha256(part.encode())
            else:
                state.update(f",{part}".encode())
        yield pd.DataFrame(done, columns=["id", "ends_sha256"])
    if last is not None:
        yield pd.DataFrame([(last, state.hexdigest())], columns=["id", "ends_sha256"])


def coin(name: Column | str, round_: int) -> Column:
    return F.xxhash64(name, F.lit(round_)) % 2 == 0


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, values...): the sum of each value over the node and all nodes below it. nodes: (id, parent_id null at a root,
    values...), a forest.

    A round rakes all childless nodes and takes nodes of one child out of their chain where a coin says so for it and not
    for its parent, so chains halve and the number of rounds is logarithmic, whatever the depth. `above` of a node is what
    the nodes taken out between it and its present parent held.
    """
    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.col(b)

    above = [f"above_{v}" for v in values]
    left = nodes.select("id", "parent_id", *values, *[F.lit(0).cast("long").alias(a) for a in above])
    raked, compressed = [], []
    for n in range(MOST_ROUNDS):
        count = left.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
        state = written(left.join(count, "id", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))), "contract")
        bare = state.filter("children = 0")
        raked.append(bare.select("id", *values))
        more = state.filter("children > 0")
        if more.isEmpty():
            break
        given = bare.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(
            F.count(F.lit(1)).alias("gone"), *[F.sum(plus(v, a)).alias(f"given_{v}") for v, a in zip(values, above)])
        more = more.join(given, "id", "left")
        zero = F.lit(0).cast("long")
        single = F.col("parent_id").isNotNull() & (F.col("children") - F.coalesce("gone", zero) == 1) & coin("id", n)
        more = written(more.select("id", "parent_id", *[(F.col(v) + F.coalesce(f"given_{v}", zero)).alias(v) for v in values], *above, single.alias("heads")), "raked")
        heads = more.filter("heads").select(F.col("id").alias("parent_id"))
        # a chosen node whose parent isn't chosen goes; its child then hangs from its parent
        out = more.filter("heads").join(heads, "parent_id", "left_anti")
        out = written(out.select(F.col("id").alias("gone_id"), F.col("parent_id").alias("gone_parent"), *[F.col(c).alias(f"gone_{c}") for c in (*values, *above)]), "compressed")
        if out.isEmpty():
            left = more.select("id", "parent_id", *values, *above)
            continue
        met = more.join(out, F.col("parent_id") == F.col("gone_id"), "left").join(out.select(F.col("gone_id").alias("id")), "id", "left_anti")
        met = written(met.select(
            "id", F.coalesce("gone_parent", "parent_id").alias("parent_id"), *values,
            *[(F.col(a) + F.when(F.col("gone_id").isNull(), zero).otherwise(plus(f"gone_{v}", f"gone_{a}"))).alias(a) for v, a in zip(values, above)],
            "gone_id", *[(F.col(f"gone_{v}") + F.col(a)).alias(f"held_{v}") for v, a in zip(values, above)]), "spliced")
        compressed.append(met.filter("gone_id IS NOT NULL").select(F.col("gone_id").alias("id"), F.col("id").alias("child"), *[F.col(f"held_{v}").alias(v) for v in values]))
        left = met.select("id", "parent_id", *values, *above)
    else:
        raise RuntimeError(f"tree not contracted after {MOST_ROUNDS} rounds")
    totals = raked[0]
    for part in raked[1:]:
        totals = totals.unionByName(part)
    totals = written(totals, "raked-totals") if compressed else totals
    for part in reversed(compressed):
        below = totals.select(F.col("id").alias("child"), *[F.col(v).alias(f"below_{v}") for v in values])
        back = part.join(below, "child").select("id", *[plus(v, f"below_{v}").alias(v) for v in values])
        totals = totals.unionByName(written(back, "expanded"))
    return totals


def prefix_trie(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(node_id, conv_id, depth, parent_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one
    row per node of the trie of the rebuilt conversations (see shared_start).

    Turns of a null conv_id take no part; a null role or text is empty; turns of one conversation and turn, repeated ones
    too, all count, in the order of their digests. Texts are taken whole. A conversation rebuilt to nothing ends at the root.
    An empty table has no root. Other columns play no role. Two different sequences are one node only if their 128-bit names
    are equal.
    """
    rows, convs = shared_start(placed_turns(turns), family, most)
    rows = written(prefix_ids(rows), "prefixes")
    zero = F.lit(0).cast("long")
    root = convs.groupBy(F.lit(ROOT).alias("id")).agg(
        F.min("conv").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("string").alias("parent_id"), F.count(F.lit(1)).alias("n_convs"), zero.alias("words"))
    nodes = rows.groupBy("id").agg(
        F.min("conv").alias("conv_id"), F.min("at").alias("depth"), F.min("parent_id").alias("parent_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = written(nodes.join(parents, "parent_id", "left"), "nodes")
    totals = subtree_totals(nodes.select("id", "parent_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = rows.filter("last").select("id", "conv").unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("id"), "conv"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(totals, "id").join(end_digests(ends), "id", "left").select(
        F.col("id").alias("node_id"), "conv_id", "depth", "parent_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"))
