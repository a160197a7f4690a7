"""The queries of this subpackage by name."""

from __future__ import annotations

from . import chat_format, filter_audit, hard_negatives, ngram_jaccard, quality_rules, suffix_dedup, url_filters
from .best_fit_packing import op4_best_fit
from .chat_format import op10_typed_parts
from .filter_audit import op13_filter_audit
from .hard_negatives import op11_blocked_gemm
from .ivf_pq import op7_ivf_pq
from .mix_sources import op9_temperature
from .ngram_jaccard import op6_prefix_tree
from .quality_classifier import op12_random_indexing
from .quality_rules import op2_line_frequency
from .sstable import op1_sstable
from .suffix_dedup import op3_suffix_array
from .suffix_tree_lm import op8_suffix_tree
from .url_filters import op5_link_graph

QUERIES = {
    "op1_sstable": op1_sstable,
    "op2_line_frequency": op2_line_frequency,
    "op3_suffix_array": op3_suffix_array,
    "op4_best_fit": op4_best_fit,
    "op5_link_graph": op5_link_graph,
    "op6_prefix_tree": op6_prefix_tree,
    "op7_ivf_pq": op7_ivf_pq,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_temperature": op9_temperature,
    "op10_typed_parts": op10_typed_parts,
    "op11_blocked_gemm": op11_blocked_gemm,
    "op12_random_indexing": op12_random_indexing,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_frequency": quality_rules.ORACLE,
    "op3_suffix_array": suffix_dedup.ORACLE,
    "op5_link_graph": url_filters.ORACLE,
    "op6_prefix_tree": ngram_jaccard.ORACLE,
    "op10_typed_parts": chat_format.ORACLE,
    "op11_blocked_gemm": hard_negatives.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
