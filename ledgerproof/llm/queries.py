"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from ledgerproof.llm.bpe import op1_byte_bpe
from ledgerproof.llm.contamination import OP6_SQL, op6_decontamination
from ledgerproof.llm.exact import OP5_SQL, op5_exact_dedup
from ledgerproof.llm.fuzzy_lines import op8_line_dedup
from ledgerproof.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from ledgerproof.llm.language import op2_language_id
from ledgerproof.llm.periodic import op11_periodic_runs
from ledgerproof.llm.personal import op4_personal_data
from ledgerproof.llm.quality import op10_quality
from ledgerproof.llm.simhash import op9_simhash
from ledgerproof.llm.substrings import OP3_SQL, op3_substring_dedup
from ledgerproof.llm.token_counts import OP7_SQL, op7_token_counts
from ledgerproof.llm.url_rules import OP12_SQL, op12_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_language_id, op3_substring_dedup, op4_personal_data, op5_exact_dedup, op6_decontamination, op7_token_counts,
        op8_line_dedup, op9_simhash, op10_quality, op11_periodic_runs, op12_url_filters, op13_hard_negatives,
    )
}
ORACLE: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op7_token_counts": OP7_SQL,
    "op12_url_filters": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
