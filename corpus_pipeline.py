"""The corpus pipeline: filter, dedup, decontaminate and pack documents, each stage written and read again.

Each stage takes any table with doc_id and text and, but for the last, returns it with all its columns, whatever they
are called, without the rows that its decision drops. Null and empty texts are texts like any other, null ids are ids
like any other, very long texts are read whole, an empty table gives an empty one, and rows are told apart by id and
text, so that rows which share an id are judged each for themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenq.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from lumenq.llm._shared import keep_rows, read_table, remove, scratch, shared_folder, text_of


#: Similarity of near copies: the general rule for stages, since the contract of 85 binds the query op9 alone.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1 for.

    Repeated rows get the same verdict. A text without words is scored like any other. Labels of one class, or none,
    give every text the same score.
    """
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), quality.remainder("doc_id", 4) == 2)
    return docs.where(quality.scorer(model)(text_of()) >= quality.THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies, white space aside: most code points, then smallest id, null first.

    Texts without any character but white space are copies of each other. Rows equal in id and text fold into one.
    """
    return keep_rows(docs, exact_dedup.exact_duplicates(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest id, null last.

    Texts whose sets of five-word shingles share 80 percent or more of their union are near copies.
    Texts without words are nobody's copies and stay. Rows equal in id and text fold into one.
    """
    return keep_rows(docs, near_dedup.near_duplicates(docs, NEAR_PERCENT))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Texts without words contain none; repeated rows get the same verdict."""
    return docs.where(~decontaminate.is_contaminated(read_table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is the end mark alone; repeated rows and null ids are packed each for themselves.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: SQL can express neither the fitted classifier nor the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents table; each result is written to the shared folder and read as the next one's docs.

    What a stage staged, and the result of the stage before it, are removed when its own result is written.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
