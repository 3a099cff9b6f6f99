"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from taxolyte.llm.chat_format import op5_chat_format
from taxolyte.llm.decontamination import op2_decontamination
from taxolyte.llm.html_extract import op1_html_extract
from taxolyte.llm.lm_score import op8_lm_score
from taxolyte.llm.near_dedup import op4_near_dedup
from taxolyte.llm.oracles import CHAT_FORMAT, QUALITY_RULES
from taxolyte.llm.packing import op7_packing
from taxolyte.llm.pii import op10_pii
from taxolyte.llm.quality_classifier import op6_quality_classifier
from taxolyte.llm.quality_rules import op3_quality_rules
from taxolyte.llm.token_store import op9_token_store

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_lm_score": op8_lm_score,
    "op9_token_store": op9_token_store,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {"op3_quality_rules": QUALITY_RULES, "op5_chat_format": CHAT_FORMAT}
