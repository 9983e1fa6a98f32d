"""Corpus pipeline over `documents`: STAGES in order, each written as Parquet and read again.

1. toxicity: documents that the classifier rejects (score >= 0.5) go.
2. ngram_join: one document of each class of near duplicates stays, the one of least doc_id.
3. substring: words covered by repeated 35-word windows go; the documents stay.
4. mixing: documents drawn to the sources' target weights; one drawn twice is two rows. Written shard
   by shard, in each in its shuffled order.
5. sentencepiece: the texts as piece ids, with the round trip back.

All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import jaccard_join, mixing, sentencepiece_codec, substring_dedup, toxicity
from gridcast.llm.common import read_table, written


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", 5, 0, toxicity.FIT_ROWS))
    return toxicity.score(docs, model, out="__toxic").filter("__toxic < 0.5").drop("__toxic")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_class(docs).select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(substring_dedup.remove_repeats(docs).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return _sized(mixed.select(*docs.columns))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = sentencepiece_codec.load_pieces()
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), pieces, decoded="decoded")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("substring", drop_repeats),
          ("mixing", mix_sources), ("sentencepiece", encode_texts)]

#: SQL can express neither the classifier nor the encoder; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
