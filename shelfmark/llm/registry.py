"""The queries of this subpackage, with SQL where SQL says the same."""

from __future__ import annotations

from shelfmark.llm.chat import op7_chat_format
from shelfmark.llm.decontam import op9_decontam
from shelfmark.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from shelfmark.llm.lines import op1_line_dedup
from shelfmark.llm.passages import op6_substring_dedup
from shelfmark.llm.pieces import op5_sentencepiece
from shelfmark.llm.quality import op3_quality
from shelfmark.llm.secrets import op4_secret_scan
from shelfmark.llm.simhash import op8_simhash
from shelfmark.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_secret_scan": op4_secret_scan,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_simhash": op8_simhash,
    "op9_decontam": op9_decontam,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {"op10_exact_dedup": OP10_SQL}
