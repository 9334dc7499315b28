"""A stored table that is kept up by key: bucketed by the key on disk, so its side of a join is never shuffled.

Files are bucketed and sorted by a hash of the key (``buckets``), within folders by another hash
(``slots``). Held against the table, incoming rows are dealt to its buckets and meet them where
they lie: only they are shuffled. New keys are appended; changed and deleted keys rewrite the
slots that they touch, first beside the table and then over it (dynamic partition overwrite), and
leave the other slots alone. What a broken-off change has written beside the table is put in place
by the next one (``recover``), so a change is done once or again, never by half.

The table is Parquet with a known layout; each session names it for itself, in its own catalog.
A row without a key has nothing to be known by and isn't stored. One writer at a time.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import versions

BUCKETS, SLOTS = 32, 8
MODE = "spark.sql.sources.partitionOverwriteMode"


@contextmanager
def _dynamic(spark: SparkSession):
    old = spark.conf.get(MODE)
    spark.conf.set(MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(MODE, old)


class KeyTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "unique_id", buckets: int = BUCKETS, slots: int = SLOTS):
        self.spark, self.path, self.key, self.buckets, self.slots = spark, path.rstrip("/"), key, buckets, slots
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.name = f"keys_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        self.columns = self.schema.fieldNames()
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        fs, where = versions.file_system(spark, f"{self.path}/rows")
        fs.mkdirs(where)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({ddl}, _slot INT) USING parquet PARTITIONED BY (_slot) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'")
        spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self.recover()

    def _slot(self):
        return F.pmod(F.xxhash64(F.lit("slot"), F.col(self.key)), F.lit(self.slots)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("_slot")

    def unseen(self, rows: DataFrame, besides=None) -> DataFrame:
        """The rows with a key that the table lacks; besides: a test of rows of the table that don't count."""
        there = self.spark.table(self.name)
        there = (there if besides is None else there.where(~besides)).select(F.col(self.key).alias("_there"))
        return rows.join(there.hint("merge"), rows[self.key] == F.col("_there"), "left_anti").where(F.col(self.key).isNotNull())

    def append(self, rows: DataFrame) -> None:
        """Adds rows whose keys the table lacks, each key once (the caller sees to both)."""
        out = rows.where(F.col(self.key).isNotNull()).select(*self.columns).withColumn("_slot", self._slot())
        out.repartition(self.buckets, self.key).write.mode("append").format("parquet").insertInto(self.name)

    def insert_new(self, rows: DataFrame, order: list) -> None:
        """Adds the rows of new keys, of several with one key the first in order."""
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*(F.col(c) for c in self.columns)), F.struct(*order)).alias("row")).select("row.*")
        self.append(self.unseen(first))

    def upsert(self, rows: DataFrame, newer: list) -> None:
        """Adds or replaces rows by key: of several with one key, stored ones too, the last by newer."""
        self._rewrite(rows.select(*self.columns), lambda mine, new: mine.unionByName(new).groupBy(self.key).agg(F.max_by(F.struct(*(F.col(c) for c in self.columns)), F.struct(*newer)).alias("row")).select("row.*"))

    def delete(self, keys: DataFrame) -> None:
        """Drops the rows of some keys."""
        self._rewrite(keys.select(self.key), lambda mine, gone: mine.join(gone.select(F.col(self.key).alias("_gone")), mine[self.key] == F.col("_gone"), "left_anti"))

    def _rewrite(self, rows: DataFrame, change) -> None:
        rows = rows.where(F.col(self.key).isNotNull())
        touched = [r[0] for r in rows.select(self._slot().alias("s")).distinct().collect()]  # at most as many as there are slots
        if not touched:
            return
        mine = self.spark.table(self.name).where(F.col("_slot").isin(touched)).drop("_slot")
        beside = f"{self.path}/beside"
        versions.remove(self.spark, beside)
        changed = change(mine, rows).withColumn("_slot", self._slot())
        changed.repartition(self.buckets, self.key).write.partitionBy("_slot").parquet(f"{beside}/rows")
        versions.put(self.spark, f"{beside}/done", 1, {"touched": touched})
        self.recover()

    def recover(self) -> None:
        """Puts in place what a change has written beside the table, if it was written whole."""
        beside = f"{self.path}/beside"
        _, done = versions.newest(self.spark, f"{beside}/done")
        if not done:
            return
        schema = T.StructType([*self.schema.fields, T.StructField("_slot", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{beside}/rows")
        left = {r[0] for r in rows.select("_slot").distinct().collect()}
        with _dynamic(self.spark):
            rows.repartition(self.buckets, self.key).write.mode("overwrite").format("parquet").insertInto(self.name)
        for slot in set(done["touched"]) - left:  # all of its rows are gone
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (_slot = {slot})")
            versions.remove(self.spark, f"{self.path}/rows/_slot={slot}")
        versions.remove(self.spark, beside)
        self.spark.sql(f"REFRESH TABLE {self.name}")
