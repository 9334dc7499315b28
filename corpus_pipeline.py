"""Five stages from raw documents to token files. Each is (name, function of spark, docs, sf_dir).

Every function takes what its predecessor kept and returns a DataFrame, which is written and
read again before the next one. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, langid, mixing, repair, similar, simhash
from tidewell.llm.common import scratch, small_batches, written
from tidewell.llm.tokens import tokenizer_path

#: Weights of the mix: this power of a source's number of documents.
MIX_POWER = 0.9


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified."""
    with small_batches(spark):
        model = langid.fit(docs.where(~langid.held_out(5, 0)))
    return langid.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group whose five-word shingles are 0.8 similar or more."""
    return simhash.one_of_each(docs, similar.components)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix at the target weights; when a source ends the others go on."""
    return mixing.mixed(docs, power=MIX_POWER, exhausted="continue")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the order of docs, which is that of its files and of the rows in them, and returns what they hold of each document."""
    to = scratch(spark, "corpus-tokens")
    try:
        order = [docs["_metadata.file_name"], docs["_metadata.row_index"]]
    except AnalysisException:  # rows that were not read from files have no order but that of doc_id
        order = None
    with small_batches(spark):
        repair.write_tokens(docs, to, tokenizer_path(), order=order)
    return repair.read_tokens(spark, to)


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pfair_mixing", mix_sources),
    ("token_files", write_token_files),
]

#: SQL has no n-gram models, fingerprints, tiling or tokenizers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
