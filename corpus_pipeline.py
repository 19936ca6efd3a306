"""A corpus through five stages; each works on all that the one before kept, written and read again.

Toxic documents go, one document of each group of near copies stays, secrets are blotted out, sources
are mixed to their target weights, and the texts are packed into sequences of tokens. All stages but the
last return the columns of documents. Null texts count as empty; nothing but the three filters drops rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, mixing, nearcopies, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, does not reject."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    names = common.free_name(docs, "toxic_score"), common.free_name(docs, "toxic_verdict")
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more), and of equal rows, the document with the smallest doc_id."""
    return nearcopies.one_of_each(docs)


def blot_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars as it is then."""
    cleaned = secrets.redact(docs.withColumn("text", F.col("text").cast("string")))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.emit(mixing.copies(rows, "size", carry=["row"], once=False)).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", blot_out_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stages score and hash by means that SQL has not; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
