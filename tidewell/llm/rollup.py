"""Token counts as delta-maintained rollups.

A batch of changes turns into signed rows: an insert adds, a delete takes away, a revised
count takes the old one away and adds the new. A commit adds the batch up by source, language
and tokenizer version and writes those few sums under the batch's name; totals are the sums of
all committed batches. Nothing is ever counted again, and nothing is changed in place.

A batch is committed when its folder is in place: the sums are written beside it first and
moved by one rename that fails where the folder exists, so of two that commit the same batch one
wins. Names of batches can be any text. So a batch that is sent
twice, or broke off half way and is sent again, counts once. ``compact`` folds batches into
one and remembers their names.

Null sources and languages are groups of their own. Null and empty texts count as documents
without tokens. Repeated rows count as often as they stand. An empty batch commits nothing but
its name. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, exists, file_system, scratch
from .tokens import encoder, tokenizer_path

KEYS = ("source", "lang", "tokenizer_version")
SUMS = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def _counts(path: str):
    def run(batches):
        import pyarrow as pa

        own = encoder(path)
        for batch in batches:
            counts = np.diff(own.encode_column(batch.column("text"))[1], prepend=0)
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "source", "lang")] + [pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens) of docs with a tokenizers file."""
    docs = docs.select(F.col("doc_id").cast("long"), *(F.col(x).cast("string") for x in ("source", "lang", "text")))
    return docs.mapInArrow(_counts(tokenizer), "doc_id long, source string, lang string, n_tokens long")


def word_counts(docs: DataFrame) -> DataFrame:
    """The same with words between white space as tokens."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1)
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), words.cast("long").alias("n_tokens"))


def changes(counted: DataFrame, version: str, kind: str, new: str = "n_tokens", old: str = "old_tokens") -> DataFrame:
    """Signed rows of one kind of change to counted documents."""
    zero = F.lit(0).cast("long")
    docs, tokens = {INSERT: (zero + 1, F.col(new)), DELETE: (zero - 1, -F.col(new)), REVISE: (zero, F.col(new) - F.col(old) if kind == REVISE else None)}[kind]
    return counted.select("source", "lang", F.lit(version).alias("tokenizer_version"), docs.alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def _name(path: str) -> str:
    return unquote(path.rpartition("batch=")[2])


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, batch: str) -> str:
        return f"{self.path}/batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return exists(self.spark, self._at(batch)) or batch in self._folded()

    def _folded(self) -> set[str]:
        names = set()
        for at in self._batches():
            if exists(self.spark, f"{at}/_folded"):
                names |= {unquote(x[0]) for x in self.spark.read.text(f"{at}/_folded").collect()}
        return names

    def _batches(self) -> list[str]:
        if not exists(self.spark, self.path):
            return []
        fs, where = file_system(self.spark, self.path)
        return sorted(str(x.getPath()) for x in fs.listStatus(where) if x.getPath().getName().startswith("batch="))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch of signed rows, once; False if it was there already."""
        if self.committed(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(*(F.sum(x).cast("long").alias(x) for x in ("n_docs", "n_tokens")))
        return self._place(batch, sums, None)

    def _place(self, batch: str, sums: DataFrame, folded: list[str] | None) -> bool:
        beside = f"{self.path}/writing-{uuid.uuid4().hex}"
        sums.write.parquet(beside)
        if folded is not None:
            self.spark.createDataFrame([(quote(x, safe=""),) for x in folded], "value string").coalesce(1).write.text(f"{beside}/_folded")
        fs, source = file_system(self.spark, beside)
        _, target = file_system(self.spark, self._at(batch))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_over[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, never_over)
        except Py4JJavaError as e:
            fs.delete(source, True)
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches."""
        batches = self._live()
        if not batches:
            return self.spark.createDataFrame([], SUMS)
        rows = self.spark.read.schema(SUMS).parquet(*batches)
        whole = rows.groupBy(*KEYS).agg(*(F.sum(x).cast("long").alias(x) for x in ("n_docs", "n_tokens")))
        return whole.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Folds the committed batches into one; one process at a time.

        The fold names what it holds, and batches named in a fold don't count, so breaking off
        before they are deleted changes no total.
        """
        batches = self._live()
        if len(batches) < 2:
            return
        names = sorted(self._folded() | {_name(x) for x in batches})
        self._place(f"folded-{uuid.uuid4().hex}", self.totals(), names)
        for at in set(self._batches()) - set(self._live()):
            fs, where = file_system(self.spark, at)
            fs.delete(where, True)

    def _live(self) -> list[str]:
        folded = self._folded()
        return [x for x in self._batches() if _name(x) not in folded]


def op9(spark, sf_dir: str) -> DataFrame:
    """Totals after inserts, deletes, revisions and one batch sent twice.

    Batch 1 inserts every document with its words as version words-1 and its byte-level BPE
    ids as bpe-1. Batch 2 moves all word counts to the revised version words-2, which counts
    the end of a document too. Batch 1 comes once more and changes nothing.
    """
    from .common import written

    docs = documents(spark, sf_dir)
    counted, _ = written(token_counts(docs, tokenizer_path()), "rollup-bpe")
    words, _ = written(word_counts(docs), "rollup-words")
    store = Rollup(spark, scratch(spark, "rollup"))
    first = changes(words, "words-1", INSERT).union(changes(counted, "bpe-1", INSERT))
    store.commit("1", first)
    store.commit("2", changes(words, "words-1", DELETE).union(changes(words, "words-2", INSERT)))
    ended = words.withColumn("old_tokens", F.col("n_tokens")).withColumn("n_tokens", F.col("n_tokens") + 1)
    store.commit("3", changes(ended, "words-2", REVISE))
    store.commit("1", first)
    return store.totals()


__all__ = ["DELETE", "INSERT", "REVISE", "Rollup", "changes", "op9", "token_counts", "word_counts"]
