"""From raw documents to packed training sequences: the stages of a corpus build.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all
but the last return the columns of ``documents``, also those that bear the name of one
of the operator's results.

Null and empty texts and null ids: a text without words fails the quality rules; the
later stages take such rows as their operators do (an empty line; equal to each other
and to nothing else; no benchmark words; one closing token).  Of rows with one doc_id and one
text, near-duplicate removal leaves one; ties go to the least doc_id, then the least
hash of the text.  Very long texts are taken whole.  An empty table passes through all
stages as an empty table, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm._spark import discard, written
from folioworks.llm.decontaminate import decontaminate
from folioworks.llm.line_dedup import line_dedup
from folioworks.llm.ngram_join import ngram_join, one_of_each
from folioworks.llm.packing import pack_documents
from folioworks.llm.quality_rules import quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` while columns that it doesn't know bear names that no result has; then the columns of ``docs`` as they were."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    done = work(docs.withColumnsRenamed(names))
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return shielded(docs, lambda own: quality_rules(own).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the last of them only; n_chars follows the text."""
    done = shielded(docs, lambda own: line_dedup(own, least_chars=20, least_docs=3))
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs, ngram_join(docs, n=3, threshold=0.5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 8 words in a row of a benchmark item go, however small their share: line dedup may have broken up longer passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shielded(docs, lambda own: decontaminate(own, benchmark, window=8).where("n_hit = 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL expresses neither tokenisation nor packing; tests compare what all stages keep with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table, deleted once the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
