"""A training-data pipeline over documents: each stage calls one operator on what its predecessor kept.

Toxicity drops the documents that the network rejects; line dedup cuts repeated three-line windows out of the
texts; near-dedup keeps one document of each group; decontamination drops documents that leak a test item;
packing lays the rest out in sequences. Texts are whole in every stage.

Defined cases, in every stage: null and empty texts are kept (they are scored as no words, have no repeated lines, link
with nothing, leak nothing and are packed as an end id alone); repeated rows are treated alike, and near-dedup keeps all
rows of the smallest id of a group; rows of one id with different texts are scored, cut and packed on their own, but go
together where near-dedup or decontamination drops their id; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import decontaminate, line_dedup, near_dedup, packing
from hearthline.llm.common import delete, table, tables_made, written
from hearthline.llm.queries import TOXIC_FROM, toxicity_scores

SIMILARITY_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC_FROM or more go."""
    return toxicity_scores(spark, docs, sf_dir).where(F.col("score") < TOXIC_FROM).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document of which no line is left goes as a whole."""
    out = line_dedup.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id."""
    return near_dedup.keep_first(docs, SIMILARITY_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the kept documents lies in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's written table; what the stages wrote for themselves, and the tables before it, are deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, given = tables_made(), docs
        docs = written(stage(spark, given, sf_dir), f"stage-{k}")
        for made in tables_made():
            if made is not docs and (made is given or all(made is not t for t in before)):
                delete(made)
    return docs
