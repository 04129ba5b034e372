"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of ``documents``.

Defined cases, for all stages: only the columns of ``documents`` are read, so further ones, whatever their names, are left out; an empty table
gives no rows; very long texts are worked on whole; what else is special is said at each stage and in its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import jaccard, mixing, packing, pii, quality
from flowlens.llm.common import fold, labelled, remove_folder, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the labelled ones outside its held-out fold, rejects.

    A null text is scored as an empty one; equal texts, repeated rows among them, share their fate; a score of exactly the threshold stays.
    """
    docs = docs.select(COLUMNS)
    model = quality.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 4) != 2, quality.DOCS_PER_CLASS))
    return docs.where(quality.score_column(spark, model, "text") >= quality.THRESHOLD)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates: five-word shingles at a similarity of 0.8 or more.

    Null and wordless texts and rows without an id link with nothing and stay; of rows alike in id and text one stays.
    """
    return jaccard.one_of_each(docs.select(COLUMNS), words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text. A null text stays null, with a null n_chars."""
    docs = docs.select(COLUMNS).withColumn("text", pii.redact_column(spark, "text"))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights; a cut repetition holds the first words of its document.

    Texts without words, null ones among them, have nothing to give and go; a null source is one of its own; repeated rows are taken alike.
    """
    sized = mixing.with_size(docs.select(COLUMNS))
    plan = mixing.mixing_plan(sized.select("source", "size", "_bin"))
    taken = mixing.with_taken(sized, plan).where("taken > 0")
    copies = taken.withColumn("text", F.explode(mixing.repeat_column("text", "size", "taken")))
    return copies.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: a row per piece with its ids, its window and its place there. A null text is the end id alone; repeated rows are packed each."""
    return packing.pack_documents(docs.select(COLUMNS), with_ids=True)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

#: The classifier, the CRF and the tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again as the next one's input.

    A result goes once the next one is written; the last one stays, since the returned frame reads it.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
