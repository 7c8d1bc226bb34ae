"""Queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

OPERATORS = {
    "op1_suffix_array_dedup": "suffix_array",
    "op2_license_scan": "licenses",
    "op3_quality_classifier": "quality",
    "op4_hilbert_packing": "packing",
    "op5_minhash_near_dedup": "minhash",
    "op6_toxicity": "toxicity",
    "op7_byte_bpe": "bpe",
    "op8_extendible_sharding": "sharding",
    "op9_cover_tree_pairs": "cover_tree",
    "op10_shifted_curve_neighbours": "curve_neighbours",
    # The same operators with parameters that give the SQL something to disagree with on small tables.
    "small_shards": "sharding",
    "embedding_links_at_low_threshold": "cover_tree",
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def llm_oracle_sql() -> dict[str, str]:
    from . import cover_tree, curve_neighbours, sharding

    return {
        "op8_extendible_sharding": sharding.oracle(),
        "op9_cover_tree_pairs": cover_tree.oracle(),
        "op10_shifted_curve_neighbours": curve_neighbours.oracle(),
        "small_shards": sharding.oracle(sharding.SMALL_SHARD_BYTES),
        "embedding_links_at_low_threshold": cover_tree.oracle(cover_tree.LOW_THRESHOLD),
    }
