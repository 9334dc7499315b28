"""The stages of the pipeline, one after the other, and the registered queries."""

import re


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from tidewell.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [set(zip(*[re.findall(r"\w+", r.text.lower())[i:] for i in range(5)], strict=False)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs.count()
        docs, _ = written(stage(spark, docs, sf_dir), "test")
        kept[name] = docs.count()
        if name == "pfair_mixing":
            mixed = [r.doc_id for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
        assert kept[name] <= before
        if name != "token_files":
            assert docs.columns == columns
        if name == "benchmark_decontamination":
            for r in docs.collect():
                grams = set(zip(*[re.findall(r"\w+", r.text.lower())[i:] for i in range(5)], strict=False))
                assert not any(b and b <= grams for b in bench)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert [r.doc_id for r in rows] == mixed  # in the order of the mix
    assert kept["language_id"] > 0.95 * 200


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages_on_odd_rows(spark, docs, no_docs, tmp_path):
    """Nulls in every column, missing and repeated ids, a very long text, clashing names; and no row at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tidewell.llm.common import written

    spark.createDataFrame([(1, "some benchmark words that stand nowhere else at all"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = docs.limit(12).withColumn("doc_id", F.when(F.col("uid") % 2 == 0, F.col("doc_id"))).withColumn("source", F.lit(None).cast("string"))
    odd = docs.union(extra).select("*", *(F.lit(1).alias(x) for x in ("gone_id", "mix_id", "node", "row", "id", "slot")))
    for frame in (odd, odd.where("false")):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            columns, before = rows.columns, rows.count()
            rows, _ = written(stage(spark, rows, str(tmp_path)), "test")
            assert rows.count() <= before and (name == "token_files" or rows.columns == columns), name
