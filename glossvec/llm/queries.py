"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossvec.llm import best_fit_packing, binary_records, chat_prefixes, exact_dedup, filter_audit, line_dedup, minhash_dedup, quality_rules, sentencepiece_tokens, site_quality, spelling_variants, suffix_dedup, toxicity
from glossvec.llm.common import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _over(table: str, name: str, apply: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: apply(tables(spark, folder, table))
    if sql is not None:
        ORACLES[name] = sql


_over("documents", "op3_quality_rules", quality_rules.quality_query, quality_rules.quality_sql())
_over("documents", "op4_line_dedup", line_dedup.lines_query, line_dedup.lines_sql())
_over("documents", "op5_exact_dedup", exact_dedup.exact_query, exact_dedup.EXACT_SQL)
_over("conversations", "op2_chat_prefixes", chat_prefixes.chat_query, chat_prefixes.CHAT_SQL)
_over("documents", "op9_best_fit_packing", best_fit_packing.packing_query)
QUERIES["op1_toxicity"] = lambda spark, folder: toxicity.toxicity_query(tables(spark, folder, "documents"), tables(spark, folder, "labels"))
_over("documents", "op6_circulant_minhash", minhash_dedup.near_query)
_over("documents", "op7_suffix_dedup", suffix_dedup.repeats_query)
_over("documents", "op8_sentencepiece", sentencepiece_tokens.pieces_query)
QUERIES["op10_site_quality"] = lambda spark, folder: site_quality.sites_query(tables(spark, folder, "documents"), tables(spark, folder, "labels"))
QUERIES["op11_filter_audit"] = lambda spark, folder: filter_audit.audit_query(tables(spark, folder, "documents"), tables(spark, folder, "labels"))
ORACLES["op11_filter_audit"] = filter_audit.audit_sql()
_over("documents", "op13_binary_records", binary_records.records_query)
_over("documents", "op12_spelling_variants", spelling_variants.variants_query)
