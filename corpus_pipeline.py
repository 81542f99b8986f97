"""The corpus pipeline: from documents to packed training windows in five stages.

Every stage takes (spark, documents, folder of the tables) and works on all its
predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm import decontaminate, line_dedup, near_duplicates, pack, toxicity
from timelens.llm.queries import table, tokenizer_path
from timelens.session import shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. The network learns from the labelled documents that are not held out."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    packed = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.score_documents(packed, model).where("toxicity < 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier ones match, counted anew; a document that loses all its words goes."""
    before = "chars_before" + "_" * max(map(len, docs.columns))  # longer than any of their names
    cleaned = line_dedup.drop_repeated_lines(docs.withColumn(before, F.length("text")))
    changed = F.length("text") < F.col(before)
    return (cleaned.where(~F.coalesce(changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
            .withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows, with checksums of the ids."""
    return pack.digest_pieces(pack.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

# A trained network and a tokenizer decide what comes out; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
