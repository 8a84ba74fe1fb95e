"""Queries of the operators of this subpackage and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from driftloom.llm.decontam import op8_benchmark_decontamination
from driftloom.llm.embed_dedup import OP7_SQL, op7_embedding_near_dedup
from driftloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from driftloom.llm.lm_score import op3_lm_scoring
from driftloom.llm.mixing import OP5_SQL, op5_source_mixing
from driftloom.llm.pii import op1_pii
from driftloom.llm.quality import op10_quality_classifier
from driftloom.llm.simhash import op4_simhash_near_dedup
from driftloom.llm.token_count import op6_token_counts
from driftloom.llm.token_shards import op2_token_shards

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_shards": op2_token_shards,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL = {
    "op5_source_mixing": OP5_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
}
