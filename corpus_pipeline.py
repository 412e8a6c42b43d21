"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing; each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairspark.llm import decontam, lines, minhash, mixing, toxicity
from fairspark.llm.common import cut, table


def _whole(docs: DataFrame) -> DataFrame:
    """The row in one column, so that no column of docs can clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose expected severity reaches the rejection level of the model fitted on `labels`."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_whole(docs), model).where(~F.col("toxic")).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten documents or more share out of every text; rows of one doc_id are one document; n_chars follows the new text. No document goes."""
    out = lines.dedup_lines(_whole(docs), id_column="row.doc_id")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the document with the smallest doc_id stays, once where rows repeat
    its text. Of an id with several texts all stay if one does. Documents without shingles and rows without doc_id, which
    cannot be told apart, stay."""
    found = cut(minhash.near_duplicates(docs).where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id", "component_id", "kept"))
    gone = found.groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("any")).where(~F.col("any")).select("__gone")
    stay = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    again = cut(found.where("kept").groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__again"))
    if again.isEmpty():
        return stay
    twice = stay.join(again, stay["doc_id"] == F.col("__again"), "left_semi")
    first = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    one = twice.withColumn("__first", first).where("__first = 1").drop("__first")
    return stay.join(again, stay["doc_id"] == F.col("__again"), "left_anti").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item, or a whole shorter item."""
    return decontam.contamination(_whole(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: every document with its source's target, the words taken and its readings, each with its position; range-sorted by the first."""
    return mixing.mix(docs)


STAGES = [("toxicity", remove_toxic), ("line_dedup", drop_lines), ("near_duplicates", keep_one_of_each_group), ("decontamination", decontaminate), ("mixing", mix_sources)]
#: The first stage is a trained model: no SQL. The stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else cut(docs), sf_dir)
    return docs
