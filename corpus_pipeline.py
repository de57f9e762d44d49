"""The corpus pipeline: each stage reads the documents that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fareindex.llm import divergence, minhash, mixing, toxicity
from fareindex.llm.common import table, written
from fareindex.llm.queries import domain_labels
from fareindex.llm.sentencepiece_codec import encode

#: Wanted token shares of the domains `quality-toxic`, and the size of the mix: a little more than there is, so that good documents
#: come once or twice and only those of unwanted domains are thinned out.
TARGETS, BUDGET = {"1-0": 0.97, "0-0": 0.01, "1-1": 0.02}, 1.1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near the references of their language, which are taken from these documents."""
    return divergence.keep(docs, divergence.language_references(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores below the limit."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_first(docs, minhash.Near())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    rates = mixing.mix(docs, domain_labels(table(spark, sf_dir, "labels")), TARGETS, mixing.Mixing(budget=BUDGET))
    return mixing.repeat(docs, written(rates, "pipeline-rates"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the check that they decode to its text."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_stage),
    ("encoding", encoding),
]

#: The stages train models and iterate, which SQL cannot express; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; between two stages the rows are a table in the shared work folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
