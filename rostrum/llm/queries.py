"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import attribution, chaining, gam, html, mixing, packing, quality, runs, secrets, simhash, suffixes, tiff, tries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    return attribution.section_report(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_media(spark, sf_dir):
    return tiff.media_report(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    return suffixes.substring_report(table(spark, sf_dir, "documents"))


def op8_chaining(spark, sf_dir):
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op9_html(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages"))


def op10_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark, sf_dir):
    return tries.shared_opening_trie(table(spark, sf_dir, "conversations"))


def op12_quality_gam(spark, sf_dir):
    return gam.score_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark, sf_dir):
    return runs.run_report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_media, op4_simhash, op5_packing, op6_mixing, op7_suffix_dedup, op8_chaining, op9_html, op10_quality, op11_prefix_trie, op12_quality_gam, op13_periodic_runs, pipeline)}
ORACLES = {"op6_mixing": mixing.ORACLE, "op11_prefix_trie": tries.ORACLE}
