"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import OP11_SQL, op11_filter_audit
from .chat import op6_chat_formatting
from .decontamination import op1_benchmark_decontamination
from .langid import op4_language_id
from .licenses import op7_license_scans
from .packing import op2_best_fit_packing
from .periodic import op13_periodic_runs
from .quality import op5_quality_classifier
from .rules import op9_quality_rules
from .secrets import op3_secret_scans
from .simhash import op8_simhash_near_dedup
from .tiktokens import op12_tiktoken_codec
from .token_counts import op10_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scans": op3_secret_scans,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_license_scans": op7_license_scans,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_tiktoken_codec": op12_tiktoken_codec,
    "op13_periodic_runs": op13_periodic_runs,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_filter_audit": OP11_SQL}
