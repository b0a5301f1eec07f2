"""The queries of this subpackage for the entry file, and SQL for those that SQL can express."""

from __future__ import annotations

from halyard.llm import checks
from halyard.llm.fingerprints import op4_fingerprints
from halyard.llm.language import op8_language
from halyard.llm.line_templates import op3_line_templates
from halyard.llm.mixing import op2_mixing
from halyard.llm.ngram_join import op7_ngram_join
from halyard.llm.packing import op1_packing
from halyard.llm.quality import op6_quality_rules
from halyard.llm.subword_lm import op5_subword_lm
from halyard.llm.token_counts import op10_token_counts
from halyard.llm.url_reputation import OP9_SQL, op9_url_reputation

QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_line_templates": op3_line_templates,
    "op4_fingerprints": op4_fingerprints,
    "op5_subword_lm": op5_subword_lm,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_language": op8_language,
    "op9_url_reputation": op9_url_reputation,
    "op10_token_counts": op10_token_counts,
    **checks.QUERIES,
}

ORACLE_SQL: dict[str, str] = {"op9_url_reputation": OP9_SQL, **checks.ORACLE_SQL}
