"""Training corpus: toxic documents out, near duplicates out, personal data masked, sources
mixed to their weights, texts encoded.

Each stage takes the documents that its predecessor kept, as a table with the columns of
``documents``; the last one returns token ids. Edge cases are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import bpe, mixing, near_text, pii, toxicity
from loomframe.llm.common import prepare, stored, table

#: Pieces that a worker of the encoding stage remembers; its process has served all stages.
REMEMBERED = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score stays below the threshold; learnt from the labelled ones."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    weights = toxicity.train(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs.select(*COLUMNS), weights)
    return scored.filter(F.col("predicted") == 0).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return near_text.deduplicate(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by its kind, disclosing terms generalised or removed."""
    prepare(spark)
    given = docs.select(*COLUMNS)
    masked = pii.sanitise(pii.find(given, pii.disclosing_terms(given)))
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint"))
    return masked.withColumn("n_chars", changed).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) with counts and digests."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    given = docs.select("doc_id", "source", "text")
    coded = bpe.round_trip(
        given, path, public_tokenizers.PATTERN, keep_ids=True, remembered=REMEMBERED
    )
    return coded.drop("text")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Training, signatures and encoding have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; between them the documents are written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
