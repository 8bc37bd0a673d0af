"""The training-data pipeline: five stages over ``documents``, each a table that the next one reads.

Defined cases of every stage: documents with null or empty texts have no language and leave in the first stage, and a
later stage takes them like any other; null keys, languages, sources and character counts stay as they are; repeated rows
are one near-copy group; texts of any length are read whole; columns beside COLUMNS are dropped at the beginning of a
stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm import decontamination, language, mixing, simhash, tokenfiles
from costweave.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; others go."""
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= language.LEAST_SCORE)
    return language.predict_documents(docs.select(*COLUMNS)).where(sure).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix in training order, once per begun repeat, each with its time."""
    docs = docs.select(*COLUMNS)
    return mixing.training_order(mixing.planned_mix(docs), docs).select(*COLUMNS, "training_time")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files in training order; what is read back of each document."""
    return tokenfiles.token_files_digest(docs.select("doc_id", "text", "training_time"), ("training_time",))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

#: Tokenizers, fingerprints and language models are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
