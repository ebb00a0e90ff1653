"""The stages, each on what the one before kept."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from slicework.llm import decontaminate, lines, quality, simhash
from slicework.llm.shared import materialize, recorded, remove

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"kept": F.lit("own"), "fp": F.lit(1)})
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.op4_robust_outliers(before).where("kept").collect()}
        if name == "line_dedup":
            assert ids == {r.doc_id for r in before.collect()} and docs.where("n_chars <> length(text)").count() == 0
            assert lines.op8_fuzzy_lines(docs).agg(F.sum("n_dropped")).first()[0] == 0
        if name == "near_dedup":
            assert ids == {r.component_id for r in simhash.op5_golay_simhash(before).collect()}
        if name == "decontamination":
            assert {r.doc_id for r in before.collect()} - ids == {r.doc_id for r in decontaminate.op10_latent_leaks(before, benchmark).collect()}
    assert docs.where("not round_trip").count() == 0 and docs.where("n_tokens <> octet_length(ids) / 4").count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls in any column, blank, very long, tied and repeated rows and clashing names go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"wort{i % 4999}" for i in range(60_000))
    odd = [(None, None, None, None), (None, "some text without an id, of ten words or more, to be kept", "en", None), (-1, "", "en", "web"), (-2, " \t\n ", None, "web"), (-3, long, None, None), (-4, "a", "en", "web"), (-5, "x\n" * 3000, "en", "web")]
    more = spark.createDataFrame([(*r, None) for r in [*odd, *odd, *[(-7, long, "en", "web")] * 2]], docs.schema)
    both = docs.unionByName(more).withColumns({c: F.lit(1) for c in ("line", "key", "digest", "ids", "decoded", "n_lines", "keep", "words", "component_id")})
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, both = both, materialize(stage(spark, both, SF), name)
        sizes.append(both.count())
        if name != "tokens":
            assert both.columns == before.columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 20
    assert both.where("not round_trip or n_tokens <> octet_length(ids) / 4").count() == 0
    assert both.where("doc_id in (-1, -2, -4, -5)").count() == 0 and both.where("doc_id is null").count() == 1


def test_run_leaves_one_table(spark):
    with recorded() as paths:
        materialize(spark.range(3), "nested")
    remove(spark, paths)
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    docs = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and next(iter(left)).startswith("tokens-") and docs.count() > 20
