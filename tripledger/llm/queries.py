"""Queries of this folder, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripledger.llm import collocations, vectors
from tripledger.llm.collocations import op11_collocations
from tripledger.llm.fingerprint import op1_fingerprints
from tripledger.llm.language import op4_language_codes
from tripledger.llm.packing import op2_pack
from tripledger.llm.pieces import op9_pieces
from tripledger.llm.quality import op10_quality
from tripledger.llm.repeats import op8_repeats
from tripledger.llm.secrets import op5_secret_spans
from tripledger.llm.simhash import op3_simhash_groups
from tripledger.llm.tokenids import op12_token_ids
from tripledger.llm.toxicity import op7_toxicity
from tripledger.llm.vectors import op6_top_k
from tripledger.llm.whitening import op13_whitening


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_pack": op2_pack,
        "op3_simhash_groups": op3_simhash_groups,
        "op4_language_codes": op4_language_codes,
        "op5_secret_spans": op5_secret_spans,
        "op6_top_k": op6_top_k,
        "op7_toxicity": op7_toxicity,
        "op8_repeats": op8_repeats,
        "op9_pieces": op9_pieces,
        "op10_quality": op10_quality,
        "op11_collocations": op11_collocations,
        "op12_token_ids": op12_token_ids,
        "op13_whitening": op13_whitening,
    }


def oracles() -> dict[str, str]:
    """DuckDB SQL of the queries whose result SQL can state."""
    return {
        "op6_top_k": vectors.ORACLE,
        "op11_collocations": collocations.ORACLE,
    }
