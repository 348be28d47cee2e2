"""A training corpus from raw documents, in five stages that each keep the columns of documents.

Every stage reads what its predecessor wrote; the last returns the digest of the token files.

Defined cases, for every stage: a null text counts as empty and passes like an empty one; null values of other
columns pass unchanged; extra columns are dropped, whatever their names; an empty table gives an empty one.  Rows
without a doc_id are never near duplicates; rows that share a doc_id are told apart by their texts, so each class keeps
one row, and of wholly equal rows one stays; benchmark items are sought by text, whatever the doc_id; the token
files hold rows of one doc_id one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bagminhash, decontam, mixing, quality, queries, token_files
from tidewell.llm._shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the incoming tokens that the mix takes.
MIX_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.7."""
    model = quality.fit_quality(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, tuple(COLUMNS)).where(F.col("score") >= queries.PREDICTED_AT).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of least doc_id, and one of wholly equal rows."""
    return bagminhash.one_of_each(docs, COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontam.clean_rows(spark, docs, queries.table(spark, sf_dir, "benchmark"), COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents by the budgets of their domain, language and source in ids of the tokenizer; none twice."""
    counted = token_files.count_ids(docs.select(*COLUMNS), queries.tokenizer_path(), "n_ids")
    counted = Scratch(spark, "counted").table("counted", counted)  # so that texts are encoded once
    mixed = mixing.mix(queries.with_domain(counted), queries.LEVELS, budget=MIX_SHARE, weight=queries.target_weight, max_epochs=1, tokens=F.col("n_ids"))
    return mixed.select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold for each document."""
    out = Scratch(spark, "corpus")
    token_files.write_tokens(docs, queries.tokenizer_path(), out)
    return token_files.read_tokens(spark, out.root)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-id binary output", token_stage),
]
#: Models, signatures and files of its own: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = queries.table(spark, sf_dir, "documents")
    written = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written.table(f"stage{i}", stage(spark, docs, sf_dir))
        if i:
            written.drop(f"stage{i - 1}")
    return docs
