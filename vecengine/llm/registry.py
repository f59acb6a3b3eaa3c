"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from vecengine.llm import decontamination, lm_scores, warc
from vecengine.llm.byte_bpe import op5_byte_bpe
from vecengine.llm.decontamination import op4_decontamination
from vecengine.llm.fingerprints import op7_fingerprints
from vecengine.llm.language import op9_language
from vecengine.llm.lm_scores import op8_lm_scores
from vecengine.llm.near_duplicates import op6_near_duplicates
from vecengine.llm.secrets import op1_secret_scans
from vecengine.llm.token_counts import op10_token_counts
from vecengine.llm.token_files import op2_token_files
from vecengine.llm.warc import op3_warc

QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_token_files": op2_token_files,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_fingerprints": op7_fingerprints,
    "op8_lm_scores": op8_lm_scores,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op4_decontamination": decontamination.SQL,
    "op8_lm_scores": lm_scores.SQL,
}
