"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once below the cluster's shared folder and read again: cuts the lineage, and a lost executor costs
    only the tasks that read."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of longs that the driver holds, as a table. An Arrow table needs no Python workers; a list of rows has workers of
    its own started on the executors, which stay beside those of the tasks."""
    names = [field.split()[0].strip("`") for field in schema.split(",")]
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)}), schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; a null id counts as the empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def training_labels(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(__id, __y) of labelled ids outside the held-out fold; ids that are null or labelled both ways are left out."""
    one = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min(label).alias("__y"), F.max(label).alias("__z")).filter("__y = __z")
    )
    return one.filter(fold(F.col("__id"), folds) != held).select("__id", "__y")


def label_counts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, id_col: str = "doc_id") -> np.ndarray:
    """Labelled rows of docs outside the held-out fold with label 0 and with label 1, all of them: a sample that is bounded
    for each label does not show their shares."""
    rows = docs.select(F.col(id_col).alias("__id")).join(training_labels(labels, label, folds, held), "__id")
    counts = {r["__y"]: r.n for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return np.array([counts.get(0, 0), counts.get(1, 0)], dtype=float)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text bytes, label) of labelled documents outside the held-out fold. At most max_rows of each label value, those
    with the smallest hash of the id, so shares of the labels come from label_counts."""
    one = training_labels(labels, label, folds, held)
    picked = None
    for value in (0, 1):
        part = one.filter(F.col("__y") == value).orderBy(F.xxhash64("__id"), "__id").limit(max_rows).select("__id", "__y")
        picked = part if picked is None else picked.unionByName(part)
    side = docs.select(F.col(id_col).alias("__id"), text_bytes(F.col(text_col)).alias("text"))
    # the sample holds at most 2 * max_rows ids, so the documents are filtered where they are read
    return side.join(F.broadcast(picked), "__id").select("text", F.col("__y").cast("int").alias("y"))


def parts(it: Iterator[pd.Series], rows: int = 128) -> Iterator[pd.Series]:
    """The series of a pandas UDF in pieces, so that results leave the worker before the whole batch is done."""
    for series in it:
        for at in range(0, len(series), rows):
            yield series.iloc[at:at + rows]


def frames(it: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The frames of mapInPandas in pieces, for results that are larger than their rows."""
    for frame in it:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]


class BitFilter:
    """A set of 64-bit hashes in a bit table of bounded size. A hash that was put in is always found; another one may be,
    which costs work and no result."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        cells = self.table.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)]
        return ((cells >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bit_filter(hashes: DataFrame, col: str, least: int = 20, most: int = 28) -> BitFilter:
    """Filter of a long column: 16 bits a row, from 2^least to 2^most bits (32 MB). Set in Spark, 64 bits to a row; at most
    2^(most - 6) rows come to the driver."""
    bits = max(least, min(most, max(1, hashes.count() * 16).bit_length()))
    slot = F.col(col).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    cells = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("cell")).agg(F.bit_or(one).alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[cells["cell"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64)
    return BitFilter(table, bits)


def places(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with `name` (long, from 0): the place of each row within its keys in the given order, rows alike in any order.

    A range shuffle over keys, order and a row number sorts all rows, so a key or a repeated row that holds a third of them
    is spread like any other. Places are counts of earlier partitions plus the place in the own one.
    """
    at, part, key_start, total = (fresh(df, c) for c in ("__at", "__part", "__start", "__n"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    cut = df.withColumn(at, F.monotonically_increasing_id())
    rows = written(
        cut.repartitionByRange(*by, F.col(at)).sortWithinPartitions(*by, F.col(at)).withColumn(at, F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn(part, F.shiftrightunsigned(at, 33))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the shuffle
    starts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(total)).select(part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(total))
    rows = rows.join(F.broadcast(starts), part).withColumn(at, F.col(total) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    if not keys:
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col(at).alias(name))
    firsts = rows.groupBy(*keys).agg(F.min(at).alias(key_start))
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in keys]
    return rows.alias("r").join(firsts.alias("f"), same).select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col(at) - F.col(key_start)).alias(name))
