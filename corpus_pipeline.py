"""A corpus from raw documents to token files: five stages, each an operator of gridlens.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm import decontaminate, jaccard, mixing, tokens, toxicity
from gridlens.llm.queries import QUERIES as OPERATORS
from gridlens.llm.queries import SQL as OPERATOR_SQL
from gridlens.llm.shared import spare, table, written

TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from the labels of the whole table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = spare(docs.columns, "_score")
    return toxicity.score(docs, model, column=score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return jaccard.without_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the rest, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_digests(tokens.encoded(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token files", token_files),
]
ORACLE_SQL = None  # a trained model and a tokenizer are not SQL; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs


QUERIES = {**OPERATORS, "pipeline": run}
SQL = {**OPERATOR_SQL, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
