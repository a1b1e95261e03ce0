"""The subpackage's registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm.chat_format import CHAT_SQL, op2_chat_formatting
from wardline.llm.decontamination import op6_decontamination
from wardline.llm.hard_negatives import NEGATIVES_SQL, op13_hard_negatives
from wardline.llm.jaccard_join import JACCARD_SQL, op4_jaccard_join
from wardline.llm.line_crf import op9_line_crf
from wardline.llm.line_dedup import op8_line_dedup
from wardline.llm.lm_scoring import op3_lm_scoring
from wardline.llm.mixing import mixing_sql, op5_source_mixing
from wardline.llm.quality_classifier import op1_quality_classifier
from wardline.llm.suffix_dedup import op10_suffix_dedup
from wardline.llm.token_alignment import op11_token_alignment
from wardline.llm.token_file import op7_token_file
from wardline.llm.topk_search import TOPK_SQL, op12_topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_source_mixing": op5_source_mixing,
        "op6_decontamination": op6_decontamination,
        "op7_token_file": op7_token_file,
        "op8_line_dedup": op8_line_dedup,
        "op9_line_crf": op9_line_crf,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_token_alignment": op11_token_alignment,
        "op12_topk_search": op12_topk_search,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": CHAT_SQL,
        "op4_jaccard_join": JACCARD_SQL,
        "op5_source_mixing": mixing_sql(),
        "op12_topk_search": TOPK_SQL,
        "op13_hard_negatives": NEGATIVES_SQL,
    }
