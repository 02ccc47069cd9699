"""The corpus pipeline: quality, near-duplicates, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from fernwell.llm.common import removed, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorisation machine rejects; it learns from labels of rows of ``docs`` outside fold 0.

    Every row is scored by its own text, whatever its id. Null texts count as empty and are scored like any other; without
    labels of both kinds all rows get the share of good labels. No rows: no rows. Other columns come along.
    """
    from fernwell.llm.quality_fm import fit, keep_good

    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies, of five-word shingles alike by 0.8 or more.

    Rows are judged each by its own text: repeated or null ids hide nothing. Null texts count as empty; of empty texts, and
    of rows alike in id and text, one stays. No rows: no rows. Other columns come along.
    """
    from fernwell.llm.simhash_dedup import keep_one

    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold four fifths or more of a benchmark item's shingles.

    Rows are judged each by its own text, with whatever id. Null and empty texts stay, as do all rows if there are no items.
    No rows: no rows. Other columns come along.
    """
    from fernwell.llm.decontaminate import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts of what is left.

    A row for each row: null ids and repeated rows are kept, null texts count as empty. No rows: no rows.
    """
    from fernwell.llm.bpe_chunks import encode_documents
    from fernwell.llm.queries import tokenizer_file

    return encode_documents(docs, tokenizer_file(), digests_only=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: Training, fingerprints and the tokenizer are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's folder is removed once the next one is written."""
    folder, docs, before = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return docs
