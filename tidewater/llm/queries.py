"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewater.llm.decontamination import op8_benchmark_decontamination
from tidewater.llm.embedding_dedup import op5_embedding_near_dedup
from tidewater.llm.exact_dedup import op11_exact_dedup
from tidewater.llm.hard_negatives import op13_hard_negatives
from tidewater.llm.mixing import op6_mixing_sources
from tidewater.llm.oracles import ORACLE_SQL
from tidewater.llm.quality import op9_quality_classifier
from tidewater.llm.ranked_search import op12_ranked_lexical_search
from tidewater.llm.secrets import op1_secret_scans
from tidewater.llm.simhash_dedup import op10_simhash_near_dedup
from tidewater.llm.substring_dedup import op3_substring_dedup
from tidewater.llm.suffix_dedup import op7_suffix_array_dedup
from tidewater.llm.token_counts import op4_token_counts
from tidewater.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
