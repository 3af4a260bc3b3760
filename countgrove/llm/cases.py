"""Queries of the training-data operators over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    cross_polytope,
    fill_in_middle,
    language,
    lexical_search,
    line_crf,
    mixing,
    quality_rules,
    rotation,
    simhash,
    sql,
    templates,
    token_counts,
    toxicity,
)
from .common import held_out

CASES: dict[str, tuple] = {}


def case(name: str, sql: str | None = None):
    def wrap(fn):
        CASES[name] = (fn, sql)
        return fn
    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@case("op1_simhash")
def op1(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@case("op2_quality_rules", sql.QUALITY_RULES)
def op2(spark, sf_dir):
    return quality_rules.judged(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@case("op3_line_crf")
def op3(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    return line_crf.score(docs, field).select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@case("op4_cross_polytope", sql.VECTORS)
def op4(spark, sf_dir):
    return cross_polytope.near_duplicates(_table(spark, sf_dir, "embeddings"))


@case("op5_byte_bpe")
def op5(spark, sf_dir):
    return byte_bpe.round_trip_digest(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)


@case("op6_mixing", sql.MIXING)
def op6(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@case("op7_toxicity")
def op7(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).select(
        "doc_id", held_out().alias("held_out"), "severity", "grade", "toxic")


@case("op8_language")
def op8(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.drop("lang"), language.learn(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@case("op9_templates")
def op9(spark, sf_dir):
    return templates.extract(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@case("op10_rotation", sql.ROTATION)
def op10(spark, sf_dir):
    return rotation.rotate(_table(spark, sf_dir, "conversations"))


@case("op11_fill_in_middle", sql.FILL_IN_MIDDLE)
def op11(spark, sf_dir):
    return fill_in_middle.digests(fill_in_middle.transform(_table(spark, sf_dir, "documents")))


@case("op12_lexical_search", sql.LEXICAL_SEARCH)
def op12(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@case("op13_token_counts")
def op13(spark, sf_dir):
    return token_counts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@case("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
