"""The registered queries of this package: the ten operators over whole tables, and the corpus pipeline's SQL."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import crosspolytope, fim, idfiles, katz, licenses, merkle, mixing, packing, quality, repeats, rollups, simhash, tokens, topk
from ..session import shared_folder
from .exchange import crc_of_id, prepare, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return add


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{table}.parquet")


@_query()
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    return quality.classify(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


@_query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack_documents(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query()
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings."""
    done = repeats.remove_repeats(_read(spark, folder, "documents").select("doc_id", "text"), 200)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents: fingerprints of three-word shingles that differ in at most three bits."""
    return simhash.near_duplicates(_read(spark, folder, "documents"), words=3, lanes=1, most=3, bands=4, digits=4)


@_query()
def op4_crosspolytope(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings of a label."""
    return crosspolytope.near_vectors(_read(spark, folder, "embeddings"), 0.98)


@_query("""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of all embeddings for every fiftieth."""
    vectors = _read(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


def domain() -> Column:
    """Domain of a source: one large crawl, the numbered reference sources, forums."""
    return F.when(F.col("source") == "src0", "web").when(F.length("source") == 4, "reference").when(F.col("source").isNotNull(), "forum")


DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'web' WHEN length(source) = 4 THEN 'reference' WHEN source IS NOT NULL THEN 'forum' ELSE 'none' END"
WEIGHTS = {"domain": {"web": 2.0, "reference": 5.0, "forum": 3.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


@_query(mixing.mix_sql(DOMAIN_SQL, WEIGHTS, 0.5, 2, 7))
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Half of all tokens, by the weights of domains and languages."""
    return mixing.mix(_read(spark, folder, "documents"), domain(), WEIGHTS, budget_share=0.5, max_epochs=2, seed=7)


@_query(licenses.scan_sql())
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License statements of all documents."""
    return licenses.scan_licenses(_read(spark, folder, "documents")).drop("found")


@_query()
def op3_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Token totals of all documents after an insert, a revision and a delete batch, the revision committed twice.

    Version 2 counts an end token for each document; every seventh document (by crc32 of its id) is revised to it, then every
    eleventh is deleted.
    """
    docs = _read(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    counted = stored(tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k/1").drop("text"), "counted")
    table = rollups.Rollups(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}")
    crc = crc_of_id(F.col("doc_id"))
    revised = counted.filter(crc % 7 == 0).withColumn("tokenizer_version", F.lit("byte_bpe_50k/2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    table.commit(1, rollups.as_changes(counted, "insert", F.lit(0)), [])
    table.commit(2, rollups.as_changes(revised, "revise", F.lit(0)), [1])
    table.commit(3, rollups.as_changes(counted.filter(crc % 11 == 0), "delete", F.lit(0)), [1, 2])
    table.commit(2, rollups.as_changes(revised, "revise", F.lit(0)), [1, 2, 3])
    return table.totals([1, 2, 3])


@_query()
def op10_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Katz backoff log probability of every document."""
    return katz.katz_scores(_read(spark, folder, "documents"), held_out_mod=10)


@_query()
def op11_idfiles(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written to files in the order of doc_id and read back from them."""
    written = idfiles.write_ids(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.read_ids(written)


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@_query(merkle.manifest_sql(LEAF, f"CASE WHEN crc % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"))
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents; every fifth (by crc32 of its id) is checked with its text lower-cased."""
    text = F.col("text")
    changed = F.when(crc_of_id(F.col("doc_id")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    done = merkle.manifest(_read(spark, folder, "documents"), LEAF, {"text": changed})
    return done.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@_query()
def op13_fim(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-middle outputs of all documents and the texts restored from them, as digests."""
    return fim.transform_digests(_read(spark, folder, "documents"))
