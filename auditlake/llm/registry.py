"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .importance import OP13_SQL, op13_importance
from .line_dedup import op5_line_dedup
from .media import op7_media_columns
from .mixing import op10_mixing
from .near_dedup import op9_prob_minhash
from .phrases import OP11_SQL, op11_phrases
from .quality import op8_quality_ftrl
from .quality_rules import OP12_SQL, op12_quality_rules
from .substring_dedup import op6_substring_dedup
from .toxicity import op3_toxicity_gbt
from .url_filter import op1_url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_url_filter": op1_url_filter,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity_gbt": op3_toxicity_gbt,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_line_dedup": op5_line_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_media_columns": op7_media_columns,
        "op8_quality_ftrl": op8_quality_ftrl,
        "op9_prob_minhash": op9_prob_minhash,
        "op10_mixing": op10_mixing,
        "op11_phrases": op11_phrases,
        "op12_quality_rules": op12_quality_rules,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict:
    return {"op2_exact_dedup": OP2_SQL, "op11_phrases": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_importance": OP13_SQL}
