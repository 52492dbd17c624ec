"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before it kept and gives Parquet to the next. All but the last keep the columns of
documents; n_chars stays the source's figure when a stage shortens a text.

Null and empty texts have too few words, so the first stage rejects them; a stage that is given them treats them as its operator states.
Null ids are never labelled, and a class of near duplicates that has only null ids keeps one row. Rows that repeat an id are judged, masked and packed
each by its own text; those that repeat id and words come out of near-duplicate removal once, and of a class the least id stays.
Further columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common, line_dedup, near_dedup, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    verdict = common.fresh(docs, "verdict")
    judged = quality.judged(docs, common.read(spark, sf_dir, "labels"), verdict)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in one of them."""
    return line_dedup.drop_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dedup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]
#: No SQL: quality hashes, near-duplicate search, the random field and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = common.keep(docs, f"stage-{name}")
    return docs
