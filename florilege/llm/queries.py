"""The training-data queries and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crossparse, curriculum, elkan, exact_dedup, idstore, importance, kmtree, licenses, minhash, secrets, simhash, sitetree, viterbi
from .shared import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.store_and_read(table(spark, sf_dir, "documents"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.identify(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.search(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": licenses.oracle(), "op9_exact_dedup": exact_dedup.ORACLE, "op10_mix_sources": curriculum.ORACLE, "op12_importance_resample": importance.oracle(), "op13_centroid_clusters": elkan.oracle()}
