"""The operators' queries over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import load
from .decontamination import decontaminate
from .filter_audit import SQL as FILTER_AUDIT_SQL
from .filter_audit import filter_audit
from .html_text import html_text
from .ngram_join import ngram_join
from .packing import pack_documents
from .periodic_runs import run_report
from .pii import pii_report
from .quality_rules import quality_rules
from .secrets import secret_report
from .sharding import hilbert_shards
from .suffix_tree import lm_scores
from .token_output import token_output
from .tokens import vocabulary
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(load(spark, sf_dir, "documents"), n=5, percent=80)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(load(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(load(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(load(spark, sf_dir, "documents"), shards=8)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(load(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(load(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(load(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_ngram_join": op6_ngram_join,
        "op7_secret_scans": op7_secret_scans,
        "op8_html_extraction": op8_html_extraction,
        "op9_sharding": op9_sharding,
        "op10_token_output": op10_token_output,
        "op11_pii": op11_pii,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op13_filter_audit": FILTER_AUDIT_SQL}
