"""A training-text pipeline: quality rules, line and document deduplication, decontamination, tokens.

Every stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicework.llm import bpe, decontaminate, lines, quality, simhash
from slicework.llm.queries import vocabulary
from slicework.llm.shared import materialize, recorded, remove, table


def _aside(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The used columns, and the rest in one struct, so that no name of theirs can clash."""
    rest = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*[docs[c] for c in rest] or [F.lit(None).alias("none")]).alias("__rest"))


def _back(out: DataFrame, docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    return out.select(*[F.col(c) if c in used else F.col("__rest")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    used = ("text", "lang", "source")
    return _back(quality.quality_verdicts(_aside(docs, used)).where("kept"), docs, used)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that repeat, exactly or nearly, one stays in all documents; n_chars follows the text."""
    used = ("doc_id", "text")
    out = _back(lines.drop_fuzzy_lines(_aside(docs, used)), docs, used)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian 32-bit integers), their number, and whether they decode to the text."""
    out = bpe.encode_documents(docs, *vocabulary())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "round_trip": same}).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The stages estimate, cluster and fold in steps that SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that all stages keep. Intermediate tables go when the stage after them is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with recorded() as paths:
            docs = materialize(stage(spark, docs, sf_dir), name)
        remove(spark, [*before, *paths[:-1]])
        before = paths[-1:]
    return docs
