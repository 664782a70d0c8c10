"""Corpus pipeline: quality rules, near duplicates, personal data, source mix, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and reread as the next
one's ``docs``.  All but the last return the columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infrarisk.llm import minhash, mixing, pieces, pii, quality
from infrarisk.llm.common import helpers, ready, release, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8) stays."""
    return minhash.drop_near_duplicates(docs, k=5, threshold=(80, 100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the balanced sample takes it."""
    return mixing.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, their Viterbi path over the same pieces, and whether both decode to the text."""
    return pieces.encode_checked(docs, ["doc_id", "source"])


#: Helper tables of the stages so far.
_USED: set[str] = set()


def _stage(stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, _USED)  # what came before is written as ``docs``: its helper tables go
        before = helpers()
        out = stage(ready(spark), docs, sf_dir)
        _USED.update(helpers() - before)
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    (name, _stage(stage))
    for name, stage in (("quality", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
                        ("source_mix", source_mix), ("encoding", encoding))
]

#: The estimated, trained and sampled stages are not SQL; the tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
