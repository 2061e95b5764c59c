"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import graph, langid, lexical, licenses, linededup, mixing, mtree, packing, pitmanyor, simhash, sstable, tokens, variants, warc
from .common import table

WORD_END, BYTE_END = 2, 1


def op1_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.tokenised_tables(table(spark, sf_dir, "documents"), tokens.vocabulary(tokens.WORD_BPE), WORD_END)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_inner(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op7_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary(tokens.BYTE_BPE), BYTE_END)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lost").alias("lines_dropped"), F.length("text").cast("long").alias("chars_left"), F.crc32("text").alias("text_crc32"))


def op11_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_token_tables, op2_source_mix, op3_top_inner, op4_language, op5_license_scan, op6_warc_derivatives, op7_graph_neighbours, op8_simhash_groups, op9_pack_sequences, op10_line_templates, op11_max_sketches, op12_spelling_variants, op13_pitman_yor, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": mixing.oracle(), "op3_top_inner": mtree.oracle(), "op5_license_scan": licenses.oracle(), "op11_max_sketches": lexical.oracle()}
