"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import audio, conversations, licences, mixing, negatives, segment, toxicity, wrappers
from barloom.llm.common import documents, held
from barloom.llm.language import identify, train, training_texts
from barloom.llm.lm import count_model, score_texts
from barloom.llm.mtree import top_inner_products, top_inner_products_sql
from barloom.llm.simhash import simhash_groups
from barloom.llm.token_files import token_file_digests


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, played as music: no table holds recordings, so Spark renders them from texts."""
    turns = documents(spark, sf_dir, "conversations").withColumn("rec", F.col("conv_id") * 1_000_000 + F.col("turn"))
    return audio.aligned(audio.fingerprints(turns, "rec", "text", decode=audio.melody, most=64 << 10))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(*training_texts(docs, ~held("doc_id", 5, 0)))
    return identify(docs, model).withColumn("held_out", held("doc_id", 5, 0))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = count_model(docs.where(~held("doc_id", 7, 2)))
    return score_texts(docs, model).withColumn("held_out", held("doc_id", 7, 2))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(*toxicity.training_rows(docs, documents(spark, sf_dir, "labels"), ~held("doc_id", 4, 2)))
    return toxicity.score(docs, model, 0.3).withColumn("held_out", held("doc_id", 4, 2))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


# Source and topic shares go by the square root of their tokens, which lifts the small ones; languages by a milder power.
MIX = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), MIX).withColumn("rate", F.round("rate", 6))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(documents(spark, sf_dir, "embeddings"))


def op8_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segmentations(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(documents(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_chroma": op1_chroma, "op2_language": op2_language, "op3_kneser_ney": op3_kneser_ney, "op4_toxicity": op4_toxicity, "op5_token_files": op5_token_files, "op6_mixing": op6_mixing, "op7_mtree": op7_mtree, "op8_segmentations": op8_segmentations, "op9_simhash": op9_simhash, "op10_licences": op10_licences, "op11_prefix_trie": op11_prefix_trie, "op12_hard_negatives": op12_hard_negatives, "op13_wrappers": op13_wrappers}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.mix_sql(MIX), "op7_mtree": top_inner_products_sql(), "op11_prefix_trie": conversations.prefix_trie_sql(), "op12_hard_negatives": negatives.hard_negatives_sql()}
