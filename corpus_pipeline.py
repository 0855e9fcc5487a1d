"""A training corpus from raw documents: each stage works on all that the one before it kept.

Within a stage rows are told apart by their place in the table that the stage reads, so rows that repeat an id, or
have none, are judged each by itself.  Columns of the input that bear the names of a stage's own columns stay as they
are; only ``target`` and ``taken`` of the last stage replace such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REJECT_AT = 0.7


def _fresh(docs: DataFrame, name: str) -> str:
    """A name like this that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _placed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their places, and the name of that column."""
    from lattica.ship import ship

    ship(spark)
    row = _fresh(docs, "_row")
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below REJECT_AT."""
    from lattica.llm.toxicity import PuToxicity
    from lattica.ship import ship

    ship(spark)
    model = PuToxicity().fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _fresh(docs, "_score")
    return model.transform(docs, score).where(F.col(score) < REJECT_AT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; documents without words form no group."""
    from lattica.llm.ngram_jaccard import NgramJaccardJoin

    docs, row = _placed(spark, docs)
    classes = NgramJaccardJoin(size=5, percent=75, id_col=row).classes(docs).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("first")
    kept = docs.select(row, "doc_id").join(classes, row).groupBy("component_id").agg(first).select(F.col("first.row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of long runs that a smaller id has; others keep their text as it is."""
    from lattica.llm.substring_dedup import SubstringDedup
    from lattica.ship import ship

    ship(spark)
    out = SubstringDedup(window=13).transform(docs, carry=docs.columns)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    from lattica.llm.decontaminate import Decontaminator

    docs, row = _placed(spark, docs)
    leaks = Decontaminator(min_match=5, coverage=0.5, id_col=row).leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words of them that it takes (``taken``) and their source's ``target``.

    Input columns of these names give way to them.
    """
    from lattica.llm.mix import SourceMix

    placed, row = _placed(spark, docs)
    taken = SourceMix().takes(docs).where("taken > 0").select(F.col("_row").alias(row), "target", "taken")
    return placed.drop("target", "taken").join(taken, row).drop(row)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: Learning is not SQL; tests hold each stage and run() against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; only the last table stays."""
    from lattica.tables import delete, new_path, scratch

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
