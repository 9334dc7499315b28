"""Incremental ingest: page batches from a stream, new rows appended once, with per-batch hooks.

Each micro-batch is judged like a batch run, held against the keys of all earlier batches and
written into a folder named by its batch id, so a batch that is run again replaces itself. The keys
are kept beside the rows in a table bucketed by them (``operators.key_table``): a batch meets them
where they lie, and only the batch is shuffled. A batch's own keys from a run that broke off don't count
against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import key_table
from ..plans.ingest import Rules, fresh

KEYS = "unique_id string, batch long"


def start(stream: DataFrame, table: str, checkpoint: str, rules: Rules, order: list[str], after: Callable[[int, DataFrame], None] | None = None, **trigger):
    """Starts the query; trigger as for trigger(), by default everything available, then stop."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        keys = key_table.KeyTable(spark, f"{table}_keys", KEYS)
        at = f"{table}/batch={batch_id}"
        fresh(dealt(rows), rules, order, lambda first: keys.unseen(first, F.col("batch") == batch_id)).write.mode("overwrite").parquet(at)
        stored = spark.read.parquet(at)
        keys.append(keys.unseen(stored.select("unique_id", F.lit(batch_id).cast("long").alias("batch"))))
        if after is not None:
            after(batch_id, stored)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dealt(rows: DataFrame) -> DataFrame:
    """A batch over all cores, however few files or pages it came in."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores, F.xxhash64(*rows.columns))


def since(table: DataFrame, column: str, cursor) -> DataFrame:
    """Rows beyond a cursor kept from the last run."""
    return table.where(F.col(column) > F.lit(cursor)) if cursor is not None else table
