"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kveil.llm import oracles
from kveil.llm.bpe import op9_bpe_trie
from kveil.llm.exact import op10_exact_dedup
from kveil.llm.licenses import op1_license_scan
from kveil.llm.negatives import op12_kronecker_negatives
from kveil.llm.packing import op8_best_fit_packing
from kveil.llm.pii import op3_personal_data
from kveil.llm.prefixes import op11_prefix_trie
from kveil.llm.quality import op2_quality_rules
from kveil.llm.rules import op13_rule_ensemble
from kveil.llm.simhash import op6_simhash_bytes
from kveil.llm.substrings import op7_super_kmers
from kveil.llm.toolcalls import op4_tool_calls
from kveil.llm.urls import op5_url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_rules,
        op3_personal_data,
        op4_tool_calls,
        op5_url_rules,
        op6_simhash_bytes,
        op7_super_kmers,
        op8_best_fit_packing,
        op9_bpe_trie,
        op10_exact_dedup,
        op11_prefix_trie,
        op12_kronecker_negatives,
        op13_rule_ensemble,
    )
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL. The other queries need tokenizers, XXH64, look-behind or a fit; tests compare them by brute force."""
    return {
        "op2_quality_rules": oracles.quality(),
        "op5_url_rules": oracles.urls(),
        "op7_super_kmers": oracles.SUBSTRINGS,
        "op10_exact_dedup": oracles.EXACT,
        "op11_prefix_trie": oracles.TRIE,
        "op12_kronecker_negatives": oracles.NEGATIVES,
    }
