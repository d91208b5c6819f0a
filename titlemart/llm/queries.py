"""The operators as registered queries, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, decontamination, exact_dedup, language_id, line_dedup, lm_scoring, minhash, packing, prefix_free_dedup, prefix_trie, secrets, substring_dedup, zone_clusters
from .common import read

END_ID = 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("text", "lang"))
    done = language_id.predicted(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return done.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_mix")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"), at_least=10)


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = prefix_free_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=50)
    return done.select(
        "doc_id", "n_bytes", "n_removed", (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=5, percent=75)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), end_id=END_ID, capacity=4096)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.score(read(spark, sf_dir, "documents"), good)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.cluster(read(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64, scale=64.0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = prefix_trie.with_shared_openings(read(spark, sf_dir, "conversations"), group=100, most=6)
    return prefix_trie.build(turns, ids).drop("enter", "exit")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_language_id,
        op2_substring_dedup,
        op3_line_dedup,
        op4_additive_ann,
        op5_secret_scan,
        op6_suffix_array_dedup,
        op7_minhash_near_dedup,
        op8_best_fit_packing,
        op9_lm_scoring,
        op10_benchmark_decontamination,
        op11_centroid_clusters,
        op12_prefix_trie,
        op13_exact_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op11_centroid_clusters": zone_clusters.oracle_sql(),
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "op13_exact_dedup": exact_dedup.ORACLE_SQL,
    }
