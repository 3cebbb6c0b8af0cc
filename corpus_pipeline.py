"""From raw documents to packed training sequences, one operator a stage.

Each stage works on all that its predecessor kept, and each but the last returns
the columns of its input.  Decisions name documents by their id: rows without an
id are never dropped by the stages that join on it, and rows that share an id
are kept or dropped together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpisleuth.llm import decontaminate, langid, minhash, packing, pii
from kpisleuth.llm.common import held_out, table, written
from kpisleuth.llm.queries import PSEUDONYM_KEY
from kpisleuth.session import tuned

LEAST_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those whose language the network doubts."""
    model = langid.fit(docs, ~held_out("doc_id", 4, 2))
    kept = langid.classify(docs, model, names=("__language", "__score"))
    return kept.where((F.col("__language") != "und") & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies."""
    copies = minhash.near_copies(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; the length follows the new text."""
    new = pii.pseudonymise(docs, PSEUDONYM_KEY, count_column="__found")
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return new.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # the first three stages can't be written in SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
