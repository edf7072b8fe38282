"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

1. language_id: documents whose language is rejected go.
2. near_dedup: of each group of near copies (five-word shingles, Jaccard 0.8 or more) one document stays. They are met by
   SimHash fingerprints and vantage-point trees (operator 6) and, further apart, by bands of MinHashes.
3. decontamination: documents that hold a benchmark item go.
4. mixing: each document comes as often as the mix to target weights takes it.
5. sharding: each document gets its virtual slot and shard.

Defined results: null texts have no language and go in the first stage; texts of any
length are read whole; of equal or near rows one stays, that with the least id that is
not null; null ids are ids like any other elsewhere; repeated rows are copies of each
other; an empty table stays empty; further columns are carried along, and those named
``virtual_slot`` or ``shard`` are replaced in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeworks.llm import decontamination, langid, mixing, sharding, simhash
from gradeworks.llm.common import written
from gradeworks.sources.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is learned and not rejected."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.remixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their virtual slot and shard."""
    return sharding.with_shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL can express neither the classifier nor near-copy groups, edit matching and budget fitting.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
