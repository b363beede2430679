"""Registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkforest.llm.alignment import op11_token_alignment
from sparkforest.llm.bpe import op9_bpe_roundtrip
from sparkforest.llm.fingerprints import op2_imatch
from sparkforest.llm.language import op10_language_id
from sparkforest.llm.licenses import OP7_SQL, op7_license_scan
from sparkforest.llm.line_dedup import OP4_SQL, op4_line_dedup
from sparkforest.llm.mixing import op13_source_mixing
from sparkforest.llm.near_duplicates import op5_setsketch
from sparkforest.llm.packing import op1_best_fit_packing
from sparkforest.llm.periodicity import op12_periodic_runs
from sparkforest.llm.quality_model import op3_quality_ranking
from sparkforest.llm.quality_rules import op6_quality_rules
from sparkforest.llm.token_files import op8_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = (op1_best_fit_packing, op2_imatch, op3_quality_ranking, op4_line_dedup, op5_setsketch, op6_quality_rules, op7_license_scan, op8_token_files, op9_bpe_roundtrip, op10_language_id, op11_token_alignment, op12_periodic_runs, op13_source_mixing)
    return {f.__name__: f for f in own} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_license_scan": OP7_SQL}
