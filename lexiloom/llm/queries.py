"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import context_tree, decontaminate, mixing, near_duplicates, pii, preferences, quality_classifier, quality_rules, sharding, url_filters
from .sql import ORACLE_SQL as ORACLE_SQL

QUERIES = {
    "op1_pii_disclosure": pii.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_minhash_near_dedup": near_duplicates.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_context_tree_weighting": context_tree.op5,
    "op6_quality_classifier": quality_classifier.op6,
    "op7_url_templates": url_filters.op7,
    "op8_jump_sharding": sharding.op8,
    "op9_preference_formatting": preferences.op9,
    "op10_source_mixing": mixing.op10,
}
