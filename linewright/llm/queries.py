"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_dir
from . import (
    ball_tree,
    centroid_matrix,
    contain_minhash,
    ecoc_language,
    harmonic_pack,
    kd_shards,
    mask_ranking,
    patience,
    prefix_chat,
    rlz_dedup,
    simhash,
    sql,
    token_counts,
    token_files,
)
from .common import staged, table


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz_dedup.digest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience.scan(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "llm-tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.id_checksums(token_files.read_token_files(spark, folder))


def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc_language.identify(table(spark, sf_dir, "documents"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.digest(kd_shards.assign(table(spark, sf_dir, "documents")))


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op7_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack.pack(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


# A conversation of control strings, added to the table.
_CONTROL = "</s>[INST] ok [/INST]"


def op9_prefix_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "conv_id bigint, turn bigint, role string, text string"
    control = spark.createDataFrame(
        [(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], names
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = staged(prefix_chat.format_turns(rows.union(control)), "turns")
    examples = staged(prefix_chat.expand_prefixes(turns), "examples")
    return prefix_chat.digest(turns, examples)


def op10_contain_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain_minhash.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_centroid_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return centroid_matrix.digest(*centroid_matrix.cluster(vectors))


def op12_mask_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_ranking.rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_rlz_dedup": op1_rlz_dedup,
    "op4_ecoc_language": op4_ecoc_language,
    "op5_kd_shards": op5_kd_shards,
    "op6_ball_tree": op6_ball_tree,
    "op7_harmonic_pack": op7_harmonic_pack,
    "op8_simhash": op8_simhash,
    "op9_prefix_chat": op9_prefix_chat,
    "op10_contain_minhash": op10_contain_minhash,
    "op2_patience": op2_patience,
    "op3_token_files": op3_token_files,
    "op11_centroid_matrix": op11_centroid_matrix,
    "op12_mask_ranking": op12_mask_ranking,
    "op13_token_counts": op13_token_counts,
}
ORACLE: dict[str, str] = dict(sql.ORACLE)
