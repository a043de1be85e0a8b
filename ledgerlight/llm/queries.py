"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, hard_negatives, jaccard_join, lexical_search, license_scan, line_dedup, neighbours, packing, quality, simhash, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_packing": packing.op2_packing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_quality": quality.op6_quality,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_search": lexical_search.op11_search,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.OP4_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op9_license_scan": license_scan.OP9_SQL, "op11_search": lexical_search.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
