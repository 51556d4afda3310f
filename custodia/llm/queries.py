"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import (
    chat, collision_search, decontaminate, hmm, html_text, jaccard_join, language_id, line_dedup, merkle,
    mixing, quality, spelling, topk,
)
from custodia.llm.tables import table


def op1_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents")).drop("dropped")


def op2_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_shingle_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_hidden_markov_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op10_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op11_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_segment_line_dedup": op1_segment_line_dedup,
    "op2_tree_scored_text": op2_tree_scored_text,
    "op3_perspective_rotation": op3_perspective_rotation,
    "op4_systematic_mix": op4_systematic_mix,
    "op5_shingle_jaccard_join": op5_shingle_jaccard_join,
    "op6_hidden_markov_model": op6_hidden_markov_model,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_fm_index_decontamination": op8_fm_index_decontamination,
    "op9_language_mixture": op9_language_mixture,
    "op10_branch_and_bound": op10_branch_and_bound,
    "op11_collision_counting": op11_collision_counting,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}
