"""A pipeline over ``documents``: quality rules, line dedup, near-duplicate removal, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

Nulls, empty texts and repeated rows have a result in every stage: rows without text go with the first one, a null doc_id
stays and is never taken for another one's copy, rows that repeat are judged one by one until near duplicates are removed.
Texts and lines of any length are taken whole. Empty tables give empty results, and columns of any name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm import blocks, op2_decontamination, op6_quality_rules, op7_sentencepiece, op8_line_dedup, op9_ngram_join


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose rules and posterior say good. Null and empty texts, and those of fewer than 50 words, go;
    equal texts get equal verdicts."""
    return op6_quality_rules.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of three lines or more; a document left without any word goes. The smallest doc_id keeps a
    passage, a null one comes last, and rows that share a doc_id keep it both."""
    out = op8_line_dedup.line_dedup(docs).filter(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates: ties are rows that share it, of which
    one stays. Rows with a null doc_id all stay."""
    return op9_ngram_join.keep_smallest(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Items without words and an empty benchmark drop nothing."""
    out = op2_decontamination.overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.filter("n_hit = 0").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, their number, and whether they decode to the text. A null text would have none."""
    import public_tokenizers

    out = op7_sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "text"])
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("row.text")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: Weak supervision and the tokenizer's pieces have no SQL; tests hold run() against plain Python for every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written under the shared folder spark.checkpoint.dir names, and
    removed once the next one is written."""
    folder = f"{blocks.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
