"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from tidemark.llm.bpe import op4_bpe
from tidemark.llm.chat import OP3_SQL, op3_chat
from tidemark.llm.filter_audit import OP12_SQL, op12_filter_audit
from tidemark.llm.fingerprints import op2_fingerprints
from tidemark.llm.language import op10_language
from tidemark.llm.language_model import op13_language_model
from tidemark.llm.packing import op8_packing
from tidemark.llm.pii import op9_pii
from tidemark.llm.quality_classifier import op1_quality
from tidemark.llm.quality_rules import op7_quality_rules
from tidemark.llm.resampling import OP11_SQL, op11_resampling
from tidemark.llm.simhash import op5_simhash
from tidemark.llm.tokenfiles import op6_token_files

QUERIES = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_resampling": op11_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_model": op13_language_model,
}

ORACLE_SQL = {"op3_chat": OP3_SQL, "op11_resampling": OP11_SQL, "op12_filter_audit": OP12_SQL}
