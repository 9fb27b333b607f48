"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cotraining, filter_audit, license_scan, line_dedup, merkle, metric_join, mixing, near_dedup, quality_rules, sharding, surrogates, winnowing
from .common import table


def _documents(op: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_reshard_min_cost_flow": _documents(sharding.op1),
    "op2_mix_efraimidis_spirakis": _documents(mixing.op2),
    "op3_winnowing_fingerprints": _documents(winnowing.op3),
    "op4_quality_rules_ngram_logistic": quality_rules.op4,
    "op5_surrogate_generation": _documents(surrogates.op5),
    "op6_minmax_hash_near_dedup": _documents(near_dedup.op6),
    "op7_bpe_chunk_reuse": _documents(bpe.op7),
    "op8_license_template_automata": _documents(license_scan.op8),
    "op9_cotraining_quality": cotraining.op9,
    "op10_deletion_neighbourhood_lines": _documents(line_dedup.op10),
    "op11_merkle_manifest": _documents(merkle.op11),
    "op12_metric_range_join": metric_join.op12,
    "op13_filter_interaction_audit": filter_audit.op13,
}
ORACLES: dict[str, str] = {
    "op6_minmax_hash_near_dedup": near_dedup.ORACLE,
    "op10_deletion_neighbourhood_lines": line_dedup.ORACLE,
    "op8_license_template_automata": license_scan.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_metric_range_join": metric_join.ORACLE,
    "op13_filter_interaction_audit": filter_audit.ORACLE,
}
