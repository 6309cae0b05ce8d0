"""From raw documents to packed training sequences, in five stages; each stage's result is written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of documents. A stage drops
the scratch tables of the one before, so a result must be written before it is handed on. An empty table passes all of
them. No stage can be said in the SQL of one query (fingerprints, byte passages, token ids), so ORACLE_SQL is None and
tests compare each stage with brute force.
"""
from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall.llm import mixing, packing, quality, repeats, simhash
from rolecall.llm.exchange import drop_scratch, prepare, stored
from rolecall.llm.queries import WEIGHTS, domain

ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; NULL and empty texts are judged as empty, copies alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: distinct five-word shingles, similarity 0.8 and more.

    Fingerprints of 192 bits find the candidates, shingle sets decide. Rows with a NULL doc_id stay.
    """
    return simhash.keep_similar(docs, words=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte passages that stand elsewhere too, n_chars counted again; NULL text becomes empty.

    Columns that are called like one the operator adds are set aside under a name of their own meanwhile.
    """
    free = "_" * (2 + max(map(len, docs.columns)))
    own = {c: f"{free}{c}" for c in repeats.ADDED if c in docs.columns}
    done = repeats.remove_repeats(docs.withColumnsRenamed(own), 200, as_text=True)
    done = done.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)})
    return done.drop(*repeats.ADDED).withColumnsRenamed({held: c for c, held in own.items()}).select(*[f"`{c}`" for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domains and languages; texts without words go."""
    return mixing.keep_mixed(docs, domain(), WEIGHTS, budget_share=0.8, seed=7)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; NULL and empty texts are one token."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048)


def _after_the_last(stage):
    """The stage, after dropping the tables of the stage before, whose result has been written by then."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [("quality classifier", good_documents), ("SimHash near-dedup", _after_the_last(one_of_each)),
          ("suffix-array dedup", _after_the_last(without_repeats)), ("mixing sources to target weights", _after_the_last(mixed)),
          ("packing", _after_the_last(packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower(), scratch=False)
    return docs
