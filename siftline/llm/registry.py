"""The queries of this package for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import bpe, lattice, lexical, licences, mixing, neighbours, privacy, quality, sharding, simhash, substrings, trie, wrappers


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {
        "op1_quality_divergence": quality.op1_quality_divergence,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_pfair_mixing": mixing.op3_pfair_mixing,
        "op4_bpe_encoding": bpe.op4_bpe_encoding,
        "op5_hilbert_neighbours": neighbours.op5_hilbert_neighbours,
        "op6_feistel_sharding": sharding.op6_feistel_sharding,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_licence_scan": licences.op8_licence_scan,
        "op9_disclosure_sanitisation": privacy.op9_disclosure_sanitisation,
        "op10_wrapper_extraction": wrappers.op10_wrapper_extraction,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_lattice_score": lattice.op13_lattice_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_feistel_sharding": sharding.OP6_SQL, "op11_lexical_search": lexical.OP11_SQL, "op12_conversation_trie": trie.OP12_SQL}
