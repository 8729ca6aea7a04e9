"""Tables that are written once and read again, for loops that need their rows in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import shared_folder

BUCKET_ROWS = 250_000  # rows of a bucket, so that what a task sorts is small however many rows there are


def materialized(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df written below the cluster's shared folder and read again: rounds don't recompute it, and a lost executor costs only
    the tasks that read. rows_a_file: the most rows of a file, 0 for any number."""
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df moved once by `key` and written below the shared folder as a bucketed table: every group, window and join by the key
    that starts from the returned rows is done where they lie, for as many readers as there are, each reading its own columns."""
    import uuid

    spark = df.sparkSession
    buckets = max(8, -(-df.count() // BUCKET_ROWS))
    table = f"tidemark_{name}_{uuid.uuid4().hex[:12]}"
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    rows.format("parquet").option("path", shared_folder(spark, name)).mode("overwrite").saveAsTable(table)
    return spark.table(table)
