"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, quality
from .ann import nearest
from .collocations import collocations
from .common import table
from .hnsw_dedup import embedding_near_duplicates
from .license_scan import license_scan
from .mixing import curriculum
from .packing import pack_documents
from .secret_scan import secret_report
from .sentence_pieces import encoding_report
from .simhash import simhash_near_duplicates
from .substring_dedup import removal_report
from .toxicity import fit, score
from .whitening import whiten


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/doc_id."""
    return license_scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op4_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


#: Weights 5, 2 and 1 as integrals over training: the first sources fade, the last grow.
CURRICULUM = (((0, 7.5), (1, 2.5)), ((0, 2), (1, 2)), ((0, 0.5), (0.5, 0.75), (1, 2)))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum(table(spark, sf_dir, "documents"), CURRICULUM, share=1.5, most=2)
    first, again = [F.round(F.get("positions", F.lit(k)), 9).alias(name) for k, name in enumerate(("position", "next_position"))]
    return mix.select("doc_id", "size", "source_size", "target", "taken", first, again)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_sentencepiece, op3_licenses, op4_embedding_dups, op5_packing, op6_simhash, op7_substrings, op8_toxicity, op9_quality, op10_secrets, op11_mixing, op12_collocations, op13_whitening)}
SQL = oracle.SQL
