"""An outbox: what is to be sent is stored first, and goes out parcel by parcel in three steps: claim, send, confirm.

A batch of messages is dealt into parcels by recipient. A worker claims a parcel by writing the next
version of its claim, which fails if another was first; a claim ends after ``lease`` seconds, and may
then be taken over. Messages are sent in tasks, each with a key that stays the same however often it is
sent, so that a service can tell repeats. Only the newest claim can be confirmed, once; what
is confirmed is the ledger. A worker that is lost between sending and confirming leaves its parcel to
the next: every message goes out at least once, and stands in the ledger exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import versions

PARCELS = 16


@dataclass
class Claim:
    parcel: str
    version: int
    worker: str


class Outbox:
    """Messages (recipient, ...) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, recipient: str, parcels: int = PARCELS):
        self.spark, self.path, self.recipient, self.parcels = spark, path.rstrip("/"), recipient, parcels
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def put(self, batch: str, rows: DataFrame) -> None:
        """Stores a batch of messages; again with the same name it replaces itself, until a parcel of it is claimed."""
        if any(x.startswith(f"{batch}-") for x in versions.names(self.spark, f"{self.path}/claims")):
            return
        key = F.sha2(F.concat_ws("|", F.lit(batch), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.schema.fieldNames())), 256)
        kept = rows.select(*self.schema.fieldNames(), key.alias("key")).dropDuplicates(["key"])
        dealt = kept.withColumn("parcel", F.pmod(F.xxhash64(self.recipient), F.lit(self.parcels)).cast("int"))
        dealt.repartition(self.parcels, "parcel").write.mode("overwrite").partitionBy("parcel").parquet(f"{self.path}/mail/{batch}")

    def open(self) -> list[str]:
        """Parcels that are not confirmed, as batch-number."""
        mail = f"{self.path}/mail"
        there = [f"{batch}-{x.partition('=')[2]}" for batch in versions.names(self.spark, mail) for x in versions.names(self.spark, f"{mail}/{batch}") if x.startswith("parcel=")]
        done = set(versions.names(self.spark, f"{self.path}/sent"))
        return [x for x in there if x not in done]

    def claim(self, worker: str, now: float, lease: float) -> Claim | None:
        """The first open parcel that nobody holds, or whose claim has ended."""
        for parcel in self.open():
            version, held = versions.newest(self.spark, f"{self.path}/claims/{parcel}")
            if version and held["until"] > now:
                continue
            if versions.put(self.spark, f"{self.path}/claims/{parcel}", version + 1, {"worker": worker, "until": now + lease}):
                return Claim(parcel, version + 1, worker)
        return None

    def messages(self, claim: Claim) -> DataFrame:
        batch, _, number = claim.parcel.rpartition("-")
        schema = T.StructType([*self.schema.fields, T.StructField("key", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/mail/{batch}/parcel={number}")

    def send(self, claim: Claim, deliver: Callable[[dict], None]) -> int:
        """Hands every message of a parcel to deliver, in tasks; how many there were."""

        def run(frames):
            import pandas as pd

            for frame in frames:
                for row in frame.to_dict("records"):
                    deliver(row)
                yield pd.DataFrame({"n": [len(frame)]})

        return self.messages(claim).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def confirm(self, claim: Claim) -> bool:
        """Enters a parcel into the ledger; False if its claim was taken over or it is there already."""
        version, _ = versions.newest(self.spark, f"{self.path}/claims/{claim.parcel}")
        return version == claim.version and versions.put(self.spark, f"{self.path}/sent/{claim.parcel}", 1, {"worker": claim.worker, "claim": claim.version})

    def ledger(self) -> DataFrame:
        """All messages of confirmed parcels."""
        done = versions.names(self.spark, f"{self.path}/sent")
        schema = T.StructType([*self.schema.fields, T.StructField("key", T.StringType())])
        if not done:
            return self.spark.createDataFrame([], schema)
        at = [(batch, number) for batch, _, number in (x.rpartition("-") for x in done)]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/mail/{batch}/parcel={number}" for batch, number in at))
