"""The queries ``opN_<name>``: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.llm import media, mixing, neardup, pieces, pii, quality, sitetree, tokencounts, topk, toxicity
from archweave.llm.common import shared_dir, ship, table


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(ship(spark), sf_dir, "documents"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents; take down those with an address in them; revise those with runs of signs; replay it all."""
    docs = table(ship(spark), sf_dir, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    signed = lambda df, n: df.select(F.lit(n).alias("sign"), "source", "lang", "text")
    address, signs = F.col("text").rlike("[a-z0-9]@[a-z0-9]"), "[*#$%&|]{3,}"
    marked = docs.filter(~address & F.col("text").rlike(signs))
    cleaned = marked.withColumn("text", F.regexp_replace("text", signs, ""))
    batches = {"1-load": signed(docs, 1), "2-takedown": signed(docs.filter(address), -1), "3-revise": signed(marked, -1).union(signed(cleaned, 1))}
    import uuid

    rollup = tokencounts.Rollup(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", {"byte_bpe_50k": tokencounts.byte_pairs(), "words_v1": tokencounts.words_v1})
    for name, changes in [*batches.items(), *batches.items()]:
        rollup.commit(name, changes)
    return rollup.totals()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(ship(spark), sf_dir, "documents"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(ship(spark), sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(ship(spark), sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(ship(spark), sf_dir, "documents"), k=3, threshold=(85, 100))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_gif_media, op2_threshold_topk, op3_token_rollup, op4_pii, op5_pfair_mix, op6_merge_dropout, op7_weak_quality, op8_toxicity, op9_site_tree, op10_minhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from archweave.llm.oracles import ORACLES

    return dict(ORACLES)
