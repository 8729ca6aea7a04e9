"""Near-duplicate vectors by NN-descent on a neighbour graph.

Equal vectors are one point with a count. Points that share a sign code of random hyperplanes seed the neighbour lists;
each round joins a point's neighbours with each other and keeps the nearest. Samples of all points and of those outside large
classes, compared with all others, audit the recall; while it is short, more hyperplane tables are added, and at last all
points are compared in blocks. Edges at the threshold give classes. Points whose
lists are saturated with links are compared with all such points of the neighbouring classes, and then all members of a
class with each other, in blocks of bounded size, so no link is lost to the length of the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frames, written
from tidemark.llm.graph import components
from tidemark.llm.topk import whole

TABLES = 16  # hyperplane tables of the first seeding
LEAF = 256  # points that share a code, on average
CHUNK = 1_024  # points of a code that are compared at a time
LIST = 16  # length of a neighbour list before it is enlarged
EXPLORE = 0.6  # least cosine of an entry of a neighbour list
AUDIT = 200  # points of the audit
AUDIT_SMALL = 2_000  # points of the audit outside the classes larger than a list
TELLS = 100  # of these with links, from which their recall is told
RECALL = 0.99
ATTEMPTS = 4
WHOLE = 4_096  # points of a block when all are compared
BLOCK = 512  # points of a block of a class

PAIRS = "a long, b long, sim double"


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(ids: np.ndarray, x: np.ndarray, size: int, floor: float) -> pd.DataFrame:
    """Each point's nearest `size` others among these, of at least the floor."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    if len(ids) > size + 1:
        cols = np.argpartition(-sims, size, axis=1)[:, :size]
    else:
        cols = np.tile(np.arange(len(ids)), (len(ids), 1))
    rows = np.repeat(np.arange(len(ids)), cols.shape[1])
    cols = cols.ravel()
    s = sims[rows, cols]
    ok = s >= floor
    return pd.DataFrame({"a": ids[rows[ok]], "b": ids[cols[ok]], "sim": s[ok]})


def coded(points: DataFrame, n: int, dim: int, tables: int, seed: int) -> DataFrame:
    """(id, slot, code): sign codes of the points in `tables` tables of random hyperplanes."""
    width = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    planes = np.random.default_rng(seed).standard_normal((dim, tables * width))

    def codes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            side = ((unit(frame["v"]) @ planes) > 0).astype(np.int64).reshape(len(frame), tables, width)
            code = (side << np.arange(width)).sum(axis=2)
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), tables), "slot": np.tile(np.arange(tables), len(frame)), "code": code.ravel()})

    return points.select("id", "v").mapInPandas(codes, "id long, slot int, code long")


def seeded(points: DataFrame, n: int, dim: int, tables: int, seed: int, size: int = LIST) -> DataFrame:
    """(a, b, sim) of near points that share a code in one of `tables` tables. A code that very many points share is dealt
    into salts; what they lose to each other, the rounds of the descent find."""
    codes = coded(points, n, dim, tables, seed)
    hot = codes.groupBy("slot", "code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * CHUNK).select("slot", "code", F.ceil(F.col("n") / (2 * CHUNK)).alias("salts"))
    dealt = codes.join(hot, ["slot", "code"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))))
    dealt = dealt.join(points.select("id", "v"), "id").repartition("slot", "code", "salt").sortWithinPartitions("slot", "code", "salt")

    def local(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in it:
            frame = frame if held is None else pd.concat((held, frame), ignore_index=True)
            groups = [g for _, g in frame.groupby(["slot", "code", "salt"], sort=True)]
            held = groups.pop()
            for g in groups:
                yield from chunks(g)
            while len(held) >= 2 * CHUNK:
                yield from chunks(held.iloc[:CHUNK])
                held = held.iloc[CHUNK:]
        if held is not None:
            yield from chunks(held)

    def chunks(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(g), CHUNK):
            own = g.iloc[at:at + CHUNK]
            if len(own) > 1:
                yield nearest(own["id"].to_numpy(), unit(own["v"]), size, EXPLORE)

    return dealt.select("slot", "code", "salt", "id", "v").mapInPandas(local, PAIRS)


def shortest(pairs: DataFrame, size: int) -> DataFrame:
    """Both directions of the pairs, once each, and the nearest `size` of each point."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return both.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= size).drop("r")


def refined(lists: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """One round: the neighbours of a point are compared with each other; pairs that are near enough."""
    fans = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    around = lists.join(fans, "a").select("a", F.col("b").alias("id")).join(points.select("id", "v"), "id")

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        return nearest(frame["id"].to_numpy(), unit(frame["v"]), size, EXPLORE)

    return around.groupBy("a").applyInPandas(local, PAIRS)


def audit(points: DataFrame, threshold: float, sample: int = AUDIT, among: DataFrame | None = None) -> DataFrame:
    """(a, b, sim): all links of a sample of points (smallest hashes of the id), by comparing it with every point. The sample
    is drawn from `among`, or from all points."""
    rows = (points if among is None else among).orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(sample).select("id", "v").toPandas()
    ids, x = rows["id"].to_numpy(dtype=np.int64), unit(rows["v"]) if len(rows) else np.zeros((0, 1))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames(it):
            if len(frame) and len(ids):
                sims = x @ unit(frame["v"]).T
                r, c = np.nonzero(sims >= threshold)
                other = frame["id"].to_numpy()[c]
                own = ids[r] != other
                yield pd.DataFrame({"a": ids[r][own], "b": other[own], "sim": sims[r, c][own]})

    return points.select("id", "v").mapInPandas(compare, PAIRS)


def links_across(points: DataFrame, lists: DataFrame, classes: DataFrame, n: int, dim: int, threshold: float, tables: int, seed: int) -> DataFrame:
    """(a, b, sim): a link of every two classes that link through points with full lists of links. Points that met and
    don't hold each other both have such lists, so these alone are compared: those of two classes that share a code and are
    not too far apart, the larger class in blocks with blocks of all its smaller neighbours."""
    full = lists.filter(F.col("sim") >= threshold).groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LIST).select("a")
    own = points.join(full, points["id"] == full["a"]).select("id", "v")
    own = written(own.join(classes, own["id"] == classes["node"]).select("id", "v", "component"), "full")
    hosts = written(coded(own, n, dim, tables, seed).join(own.select("id", "component"), "id").select("slot", "code", "component").distinct(), "class-codes")
    other = hosts.select("slot", "code", F.col("component").alias("component_"))
    met = hosts.join(other, ["slot", "code"]).filter("component < component_").select("component", "component_").distinct()
    # of each class a point as the centre, the least cosine with it and the number of points
    centres = own.groupBy("component").agg(F.min_by("v", "id").alias("centre"), F.count(F.lit(1)).alias("size"))

    def cosines(a: str, b: str, out: str) -> object:
        def local(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in it:
                if len(frame):
                    yield frame.drop(columns=[a, b]).assign(**{out: np.einsum("ij,ij->i", unit(frame[a]), unit(frame[b]))})
        return local

    reach = own.join(centres, "component").select("component", "v", "centre").mapInPandas(cosines("v", "centre", "reach"), "component long, reach double")
    centres = written(centres.join(reach.groupBy("component").agg(F.min("reach").alias("reach")), "component"), "centres")
    far = centres.select(*[F.col(c).alias(f"{c}_") for c in centres.columns])
    sides = met.join(centres, "component").join(far, "component_")
    sides = sides.mapInPandas(cosines("centre", "centre_", "apart"), "component_ long, component long, size long, reach double, size_ long, reach_ double, apart double")
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))))
    sides = sides.filter(angle("apart") <= angle("reach") + angle("reach_") + math.acos(threshold) + 1e-6)
    first = F.struct("size", "component") > F.struct("size_", "component_")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    sides = written(sides.select(
        pick("component", "component_").alias("host"), pick("component_", "component").alias("guest"), pick("size", "size_").alias("size"),
        pick("size_", "size").alias("guests")), "class-pairs")
    blocks = sides.groupBy("host").agg(F.ceil(F.first("size") / BLOCK).cast("int").alias("m"), F.ceil(F.sum("guests") / BLOCK).cast("int").alias("k"))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = own.join(blocks, own["component"] == blocks["host"]).select("host", part("m").alias("i"), every("k").alias("j"), "id", "v", F.lit(None).cast("long").alias("guest"))
    right = own.join(sides, own["component"] == sides["guest"]).join(blocks, "host").select("host", every("m").alias("i"), part("k").alias("j"), "id", "v", "guest")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame["guest"].isna().to_numpy()
        a, b = frame[mine], frame[~mine]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        sims = unit(a["v"]) @ unit(b["v"]).T
        at = sims.argmax(axis=0)
        out = pd.DataFrame({"a": a["id"].to_numpy()[at], "b": b["id"].to_numpy(), "sim": sims[at, np.arange(len(b))], "guest": b["guest"].to_numpy()})
        out = out[out["sim"] >= threshold].sort_values("sim", ascending=False).drop_duplicates("guest")
        return out[["a", "b", "sim"]]

    return left.unionByName(right).groupBy("host", "i", "j").applyInPandas(best, PAIRS)


def links_in_classes(members: DataFrame, threshold: float) -> DataFrame:
    """(id, linked): for points (id, v, times, component, size) the number of vectors of other points of the class within
    the threshold. Blocks of a class meet in pairs; only counts leave a task."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int")})
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = dealt.select("component", F.col("own").alias("i"), every.alias("j"), "id", "v", "times", F.lit(True).alias("left")).unionByName(
        dealt.select("component", every.alias("i"), F.col("own").alias("j"), "id", "v", "times", F.lit(False).alias("left")))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame["left"].to_numpy(dtype=bool)
        a, b = frame[left], frame[~left]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "linked": []})
        near = (unit(a["v"]) @ unit(b["v"]).T >= threshold) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :])
        return pd.DataFrame({"id": a["id"], "linked": near @ b["times"].to_numpy(dtype=np.int64)})

    return sides.groupBy("component", "i", "j").applyInPandas(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, rounds: int = 4, seed: int = 7,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors within the threshold), component_id (smallest id reachable over
    links, its own included), kept (it is that one).

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, and vectors link only
    with vectors of as many components. Equal vectors are one point, so copies link without being paired. Every row counts:
    rows that repeat an id are vectors of their own. A null id is kept and is larger than all others.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    good = F.coalesce(whole(v) & F.exists(v, lambda x: x != 0), F.lit(False))
    doubles = F.transform(v, lambda x: x.cast("double") + 0.0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.when(good, F.xxhash64(F.lit(1), doubles)).alias("h1"), F.when(good, F.xxhash64(F.lit(2), doubles)).alias("h2"),
        F.when(good, doubles).alias("v"))
    rows = written(rows, "vectors")
    points = rows.filter("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v"))
    points = written(points.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "points")
    sizes = {r.dim: r.n for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()}  # one row a vector length
    linked = None
    for dim, n in sizes.items():
        own = points.filter(F.col("dim") == dim) if len(sizes) > 1 else points
        pairs = linked_pairs(own, n, dim, threshold, tables, rounds, seed)
        linked = pairs if linked is None else linked.union(pairs)
    if linked is None:
        linked = spark.createDataFrame([], PAIRS)
    classes = components(linked)
    sized = classes.join(classes.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    members = points.join(sized, points["id"] == sized["node"]).select("id", "least", "times", "v", "component", "size")
    members = written(members, "members")
    inside = links_in_classes(members, threshold)
    names = members.groupBy("component").agg(F.min("least").alias("name"))
    known = members.select("id", "component").join(names, "component").join(inside, "id").select("id", "name", "linked")
    by_point = points.join(known, "id", "left").select("h1", "h2", F.coalesce("name", "least").alias("name"), (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).alias("n"))
    out = rows.select("vec_id", "h1", "h2").join(by_point, ["h1", "h2"], "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("name", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("name", "vec_id"), F.lit(True)).alias("kept"))


def tables_for(n: int, threshold: float, least: int) -> int:
    """Tables after which a pair at the threshold has shared a code with probability RECALL; `least` or more."""
    share = (1 - math.acos(threshold) / math.pi) ** max(0, math.ceil(math.log2(max(1, n / LEAF))))
    return least if share >= 1 else max(least, math.ceil(math.log(1 - RECALL) / math.log1p(-share)))


def recall(checked: DataFrame, classes: DataFrame) -> tuple[float, int]:
    """Mean over the audited points that have links of the share of links inside a class, and the number of those points."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    hit = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("int")
    each = checked.join(side("a"), "a", "left").join(side("b"), "b", "left").groupBy("a").agg(F.avg(hit).alias("share"))
    r = each.agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("n")).first()
    return (1.0 if r.share is None else r.share), r.n


def every_link(points: DataFrame, classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, sim): of all pairs of points, in blocks, a link of every two classes that link; a point of none is its own."""
    k = -(-n // WHOLE)
    own = points.join(classes, points["id"] == classes["node"], "left").select("id", "v", F.coalesce("component", "id").alias("component"))
    own = written(own.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(k)).cast("int")), "blocks")
    left = own.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(k - 1)))).select(F.col("block").alias("i"), F.col("other").alias("j"), "id", "v", "component", F.lit(True).alias("left"))
    right = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).select(F.col("other").alias("i"), F.col("block").alias("j"), "id", "v", "component", F.lit(False).alias("left"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["left"].to_numpy(dtype=bool)
        a, b = frame[side], frame[~side]
        out = pd.DataFrame({"a": [], "b": [], "sim": [], "ca": [], "cb": []})
        if len(a) and len(b):
            y, ids, own_class = unit(b["v"]).T, b["id"].to_numpy(), b["component"].to_numpy()
            for at in range(0, len(a), BLOCK):
                part = a.iloc[at:at + BLOCK]
                sims = unit(part["v"]) @ y
                r, c = np.nonzero((sims >= threshold) & (part["component"].to_numpy()[:, None] != own_class[None, :]))
                new = pd.DataFrame({"a": part["id"].to_numpy()[r], "b": ids[c], "sim": sims[r, c], "ca": part["component"].to_numpy()[r], "cb": own_class[c]})
                out = new if not len(out) else pd.concat((out, new), ignore_index=True)
                out = out.drop_duplicates(["ca", "cb"])
        return out[["a", "b", "sim"]]

    return left.unionByName(right).groupBy("i", "j").applyInPandas(meet, PAIRS)


def linked_pairs(points: DataFrame, n: int, dim: int, threshold: float, tables: int, rounds: int, seed: int) -> DataFrame:
    """Edges of at least the threshold between points of one length. The audit is of points of the whole table and of points
    outside the larger classes, each by the mean share of a point's links. Where too few of the latter have links to tell, an
    attempt must find no new link between classes. When the last attempt is short, all points are compared."""
    tables = tables_for(n, threshold, tables)
    pairs = checked = few = merged = None
    for attempt in range(ATTEMPTS):
        fresh_pairs = seeded(points, n, dim, tables << attempt, seed + attempt)
        lists = written(shortest(fresh_pairs if pairs is None else pairs.union(fresh_pairs), LIST), "lists")
        had = lists.count()
        for _ in range(rounds):
            lists = written(shortest(lists.union(refined(lists, points, LIST)), LIST), "lists")
            now = lists.count()
            if now - had <= 0.001 * had:
                break
            had = now
        pairs = lists
        edges = lists.filter(F.col("sim") >= threshold)
        across = links_across(points, lists, components(edges), n, dim, threshold, tables << attempt, seed + attempt)
        edges = edges.union(written(across, "across"))
        classes = components(edges)
        if checked is None:
            large = classes.groupBy("component").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LIST)
            inside = classes.join(large, "component").select("node")
            outside = written(points.select("id", "v").join(inside, F.col("id") == F.col("node"), "left_anti"), "outside")
            all_seen = outside.count() <= AUDIT_SMALL
            checked = written(audit(points, threshold), "audit")
            few = written(audit(points, threshold, AUDIT_SMALL, outside), "audit")
        was, merged = merged, classes.count() - classes.select("component").distinct().count()
        small, told = recall(few, classes)
        short = recall(checked, classes)[0] < RECALL or (small < RECALL and not all_seen)
        if not short and (all_seen or told >= TELLS or merged == was):
            return edges.union(checked).union(few)
    return edges.union(checked).union(few).union(every_link(points, classes, n, threshold))
