"""The queries of this folder: one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import oracles
from scriptorium.llm.ann import op1_ann
from scriptorium.llm.decontamination import op13_decontamination
from scriptorium.llm.fingerprint import op7_fingerprint
from scriptorium.llm.html_text import op9_html_extraction
from scriptorium.llm.maxent_lm import op6_maxent_lm
from scriptorium.llm.merkle import op12_merkle
from scriptorium.llm.near_dedup import op5_near_dedup
from scriptorium.llm.packing import op3_packing
from scriptorium.llm.piece_sampling import op2_piece_sampling
from scriptorium.llm.resampling import op11_resampling
from scriptorium.llm.secret_scan import op8_secret_scan
from scriptorium.llm.suffix_dedup import op10_suffix_dedup
from scriptorium.llm.toxicity import op4_toxicity


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline (imported when it runs: it lies beside the package and imports this folder)."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    """Name -> callable (spark, sf_dir) -> DataFrame."""
    return {
        "op1_ann": op1_ann,
        "op2_piece_sampling": op2_piece_sampling,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_near_dedup": op5_near_dedup,
        "op6_maxent_lm": op6_maxent_lm,
        "op7_fingerprint": op7_fingerprint,
        "op8_secret_scan": op8_secret_scan,
        "op9_html_extraction": op9_html_extraction,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_resampling": op11_resampling,
        "op12_merkle": op12_merkle,
        "op13_decontamination": op13_decontamination,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op5_near_dedup": oracles.OP5,
        "op11_resampling": oracles.OP11,
        "op12_merkle": oracles.OP12,
        "op13_decontamination": oracles.OP13,
    }
