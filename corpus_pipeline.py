"""The corpus pipeline: stages that each call one operator of barloom.llm, chained through Parquet tables.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Labels are learned as in the operators' own queries. `documents` rows are keyed by doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import language, mixing, segment, similar, toxicity
from barloom.llm.common import documents, held, written
from barloom.llm.queries import MIX

KEEP = 0.8  # tokens that mixing draws, in parts of all


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of probability 0.3 at least, go."""
    model = language.train(*language.training_texts(docs, ~held("doc_id", 5, 0)))
    return docs.where(language.is_accepted(model, 0.3))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    model = toxicity.fit(*toxicity.training_rows(docs, documents(spark, sf_dir, "labels"), ~held("doc_id", 4, 2)))
    return docs.where(toxicity.is_accepted(model, 0.3))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (Jaccard similarity of five-word shingles 0.8 or more) the document of the least id stays."""
    return similar.one_of_each(docs, shingle=5, least="0.8")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drawn to target weights of source, language and topic; documents of scarce cells are repeated, and so are their ids."""
    return mixing.selected(docs, MIX, KEEP)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with ids; copies that mixing made are numbered and draw each their own."""
    numbered = mixing.copy_numbers(docs, "__copy")
    return segment.segmentations(numbered, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, most=1 << 19, copy_col="__copy")


STAGES = [("language", identified), ("toxicity", civil), ("near-dedup", distinct), ("mixing", mixed), ("segmentation", segmented)]
ORACLE_SQL = None  # the trained stages and the sampled segmentations have no SQL; tests/llm hold each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
