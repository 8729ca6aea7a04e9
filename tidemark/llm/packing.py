"""Best-fit packing by a plan over length counts.

Pieces are counted by length, best-fit places counts (not documents) into sequences, and pieces take the planned slots by
joining on their rank within their length. The plan has at most capacity lengths, and a stretch of equal sequences is
touched at most log2(capacity) times because placing a length leaves less than half of the room; so it has at most about
3 * capacity * log2(capacity) rows whatever the input, and only it and the histogram come to the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, small_table, text_bytes, written
from tidemark.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048
PLAN = "len int, first long, count long, per int, sequence long, place int"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts. A row (length, first rank, count, per, sequence, place) puts the ranks first
    to first + count - 1 of that length into sequences from `sequence` on, `per` in each, from offset `place` on."""
    rows = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []  # heap of rooms that may have runs
    made = 0

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            if not open_runs.get(room):
                open_runs[room] = []
                heapq.heappush(rooms, room)
            open_runs[room].append((start, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in sorted({r for r in rooms if r >= length and open_runs.get(r)}):
            runs, open_runs[room] = open_runs[room], []
            while runs and left:
                start, n = runs.pop()
                per = room // length
                full = min(n, left // per)
                if full:
                    rows.append((length, rank, full * per, per, start, capacity - room))
                    put(room - per * length, start, full)
                    rank, left = rank + full * per, left - full * per
                    start, n = start + full, n - full
                if n and left and left < per:  # what is left goes into one more sequence
                    rows.append((length, rank, left, left, start, capacity - room))
                    put(room - left * length, start, 1)
                    start, n, rank, left = start + 1, n - 1, rank + left, 0
                if n:
                    runs.append((start, n))
            for start, n in runs:
                put(room, start, n)
            if not left:
                break
        per = capacity // length
        full = left // per
        if full:
            rows.append((length, rank, full * per, per, made, 0))
            put(capacity - per * length, made, full)
            rank, left, made = rank + full * per, left - full * per, made + full
        if left:
            rows.append((length, rank, left, left, made, 0))
            put(capacity - left * length, made, 1)
            made += 1
        rooms = [r for r in set(rooms) if open_runs.get(r)]
        heapq.heapify(rooms)
    return rows


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids) of every whole text: its token ids and end_id, cut into pieces of `capacity`.
    ids are binary, little-endian unsigned 32-bit. One narrow pass; a null text is one piece that holds end_id alone."""
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]
    ending = np.array([end_id], dtype="<u4").tobytes()

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for frame in it:
            rows = []
            for key, text in zip(frame["id"], frame["t"]):
                ids = enc.encode(bytes(text).decode("utf-8", "replace")) + ending
                rows += [(key, k, k * capacity, ids[4 * k * capacity:4 * (k + 1) * capacity]) for k in range(-(-len(ids) // (4 * capacity)))]
            keys, pieces, starts, parts = zip(*rows) if rows else ((), (), (), ())
            out = pd.DataFrame({"piece": pieces, "start": starts, "length": [len(p) // 4 for p in parts], "ids": parts})
            out.insert(0, id_col, pd.Series(keys, dtype=frame["id"].dtype))
            yield out

    # ids may be null: pandas' nullable integers keep them apart from floats
    def kept(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return cut(f.assign(id=f["id"].astype(object)) for f in it)

    return docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("t")).mapInPandas(
        kept, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", spread: int = 64) -> DataFrame:
    """pieces with sequence_id and offset (columns of these names are replaced). Rows of null or negative length are
    refused by an error, as are lengths above the capacity.

    Rank within length is a running count over `spread` salts of every length, so that no task holds all pieces of a
    common length. The plan and the salts' offsets, both of bounded size, are broadcast.
    """
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in ("sequence_id", "offset")])
    salt, tie, rank, size, base_col, slots, hit = (fresh(pieces, c) for c in ("__salt", "__tie", "__rank", "__len", "__base", "__runs", "__hit"))
    wrong = F.col(length_col).isNull() | (F.col(length_col) < 1) | (F.col(length_col) > capacity)
    checked = F.when(wrong, F.raise_error(F.lit(f"piece length outside 1 to {capacity}"))).otherwise(F.col(length_col)).cast("int")
    rows = written(pieces.withColumn(length_col, checked.cast(dict(pieces.dtypes)[length_col])).withColumn(tie, F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(tie), F.lit(spread)).cast("int"))
    tally = [(r[0], r[1], r[2]) for r in rows.groupBy(F.col(length_col).cast("int"), salt).agg(F.count(F.lit(1))).collect()]  # at most capacity * spread rows
    starts, counts = [], {}
    for length, s, n in sorted(tally):
        starts.append((length, s, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    spark = pieces.sparkSession
    base = small_table(spark, starts, f"`{size}` int, `{salt}` int, `{base_col}` long")
    planned = small_table(spark, plan(counts, capacity), PLAN)
    runs = planned.select(F.col("len").alias(size), F.struct("first", "count", "per", "sequence", "place").alias("run"))
    runs = runs.groupBy(size).agg(F.sort_array(F.collect_list("run")).alias(slots))
    order = Window.partitionBy(length_col, salt).orderBy(tie)
    ranked = rows.withColumn(rank, F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(base), (ranked[length_col] == base[size]) & (ranked[salt] == base[salt])).drop(base[salt]).drop(size)
    joined = joined.withColumn(rank, F.col(rank) + F.col(base_col))
    joined = joined.join(F.broadcast(runs), joined[length_col] == runs[size])
    run = F.expr(f"filter(`{slots}`, r -> r.first <= `{rank}` AND `{rank}` < r.first + r.count)[0]")
    at = F.col(rank) - F.col(f"{hit}.first")
    return joined.withColumn(hit, run).select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col(f"{hit}.sequence") + F.floor(at / F.col(f"{hit}.per"))).cast("long").alias("sequence_id"),
        (F.col(f"{hit}.place") + F.pmod(at, F.col(f"{hit}.per").cast("long")) * F.col(length_col)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of all documents with their slots: doc_id, piece, start, length, ids, sequence_id, offset."""
    return best_fit(token_pieces(docs, vocabulary, capacity, end_id), capacity)
