"""A corpus pipeline of five stages; each is written and read again before the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import MADE, discard, written
from latticework.functions.hubs import listed
from latticework.llm import best_fit_packing, decontaminate, quality_rules, secret_scan, simhash_dedup
from latticework.llm.queries import word_tokenizer


#: Helper tables of each stage that ran, by place; the next stage drops them, as its own input was written by then.
_HELPERS: dict[int, list[str]] = {}


def _tidy(place: int):
    """Keeps note of the helper tables of stage ``place`` and drops those of the stage before."""

    def wrap(stage):
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            discard(spark, _HELPERS.pop(place - 1, []))
            before = set(MADE)
            out = stage(spark, docs, sf_dir)
            _HELPERS[place] = [p for p in MADE if p not in before]
            return out

        return functools.wraps(stage)(run_stage)

    return wrap


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, written so that every reading has the same keys."""
    key = "_row"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


@_tidy(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that they remove."""
    return quality_rules.cleaned(docs)


@_tidy(1)
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies."""
    marked, key = _numbered(docs)
    first = simhash_dedup.first_of_similar(marked, id_col=key).select(F.col("doc_id").alias(key))
    later = marked.select(key).join(first, key, "left_anti")  # ids alone are shuffled
    return listed(marked, later, key, "left_anti").select(*docs.columns)


@_tidy(2)
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly such passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_tidy(3)
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secret_scan.redacted(docs)


@_tidy(4)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return best_fit_packing.pack(docs, word_tokenizer())


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("secret scans", secret_stage), ("best-fit packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
