"""A corpus from raw documents to pieces: quality, near copies, privacy, mixing, encoding.

Every stage takes what its predecessor kept and decides over all of it. All but the last return the columns of
``documents``: quality drops junk, near-dedup keeps one document of each group, privacy replaces confirmed spans in
the texts, mixing writes the rows in slot order, encoding turns the texts into pieces and
names each row's slot, by which the result of ``run`` is sorted: files and their order do not carry it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.llm import mixing, neardup, pieces, pii, quality
from archweave.llm.common import Stage, ship, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group one row stays, that of the smallest id."""
    ship(spark)
    return neardup.keep_one(docs, k=5, threshold=(80, 100))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slots follow from the ids and the sizes of the sources, which mixing leaves as they are."""
    ship(spark)
    return pieces.encode_documents(mixing.mix(docs, in_order=False), place_col="mix_slot")


STAGES = [
    ("quality", keep_quality),
    ("near-dedup", keep_one_of_each),
    ("pii", mask_private),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        before = docs
        docs = stage.write(step(spark, docs, sf_dir))
        if i:
            stage.drop(before)
    return docs.orderBy("mix_slot", F.col("doc_id").cast("string"))


#: The last two stages rest on a vocabulary and hashes that SQL lacks; tests hold each stage against brute force.
ORACLE_SQL = None
