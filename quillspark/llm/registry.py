"""Queries and SQL of this subpackage, for __spark_entry__."""

from __future__ import annotations

from .chat import op7_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .interaction import OP12_SQL, op12_filter_audit
from .licenses import OP8_SQL, op8_license_scan
from .lines import OP1_SQL, op1_line_dedup
from .minhash import op10_near_duplicates
from .packing import op6_best_fit_packing
from .passages import OP13_SQL, op13_substring_dedup
from .quality import OP4_SQL, op4_quality_rules
from .search import OP11_SQL, op11_lexical_search
from .suffixes import op5_suffix_dedup
from .tokens import op2_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_format": op7_chat_format,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}
SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op8_license_scan": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
