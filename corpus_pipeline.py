"""The corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtally.llm import bpe, mixing, ngram_join, pu_quality, quality_rules, shared
from loomtally.llm.queries import VOCABULARY
from loomtally.llm.shared import documents, written


#: Scratch folders of the stage that ran last.
_left: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose result is written and read again before the next one begins: so what a stage has left in the scratch folder for its own
    result is removed then."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.remove(spark, _left)
        known = shared.scratch_since([])
        out = work(spark, docs, sf_dir)
        _left[:] = shared.scratch_since(known)
        return out

    return run_stage


@stage
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them. Repeated rows are judged alike; other columns are kept."""
    return quality_rules.keep_documents(docs)


@stage
def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the kept rows' labels, rejects go; without trusted positives all stay."""
    return pu_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; of repeated rows one; rows with a null doc_id all stay."""
    return ngram_join.keep_one(docs)


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; documents without words as often as their source's rate says."""
    return mixing.mix(docs)


@stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source of every row, and the digests of its token ids and decoded text; a null text has no tokens."""
    return bpe.encode_texts(docs.select("doc_id", "source", "text"), VOCABULARY, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_join", ngram_join_stage),
    ("mix_sources", mix_stage),
    ("bpe", bpe_stage),
]

#: The classifier is trained, so SQL can't express the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
