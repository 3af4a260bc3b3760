"""The training corpus: documents through classifier, rules, near-dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns the rows it
keeps with the columns of `docs`; the last returns the token digests. `run` writes each stage
to the shared folder and reads it again, so a stage is computed once and a lost executor costs
its own tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countgrove.llm import byte_bpe, line_crf, mixing, near_copies, quality_rules
from countgrove.llm.common import free_name
from countgrove.plans.scratch import release, written

GOOD = 0.7                                     # quality from which the classifier keeps a document
RADIUS = 2                                     # bits by which fingerprints of near-duplicates differ at most
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of quality GOOD or more; the field learns from the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = free_name(docs, "score")
    scored = line_crf.score(docs, line_crf.train(docs, labels), name=name)
    return scored.filter(F.col(name) >= GOOD).drop(name)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are near a language of the corpus."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, radius: int | None = None) -> DataFrame:
    """Keeps the document of the smallest id in each class of texts that share 0.8 of their 5-word shingles.

    With a `radius`, texts whose SimHash fingerprints differ in no more bits than that are linked too.
    """
    return near_copies.keep_first(docs, radius=radius)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: by SimHash, and by shared shingles where SimHash finds none."""
    return drop_near_copies(spark, docs, sf_dir, RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits documents as often as the target of their source asks for."""
    return mixing.emit(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each emitted document."""
    return byte_bpe.round_trip_digest(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

ORACLE_SQL = None   # a fitted field and byte-pair merges have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, last, sf_dir), name)
        release(last)   # the tables given are not among those it may delete
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
