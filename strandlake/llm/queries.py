"""Queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from strandlake.llm.decontaminate import op1_decontaminate
from strandlake.llm.html_text import op6_extract
from strandlake.llm.lexical_search import op12_lexical_search
from strandlake.llm.near_duplicates import op7_near_duplicates
from strandlake.llm.oracle import ORACLE_SQL
from strandlake.llm.packing import op3_pack
from strandlake.llm.quality import op10_quality
from strandlake.llm.quality_rules import op4_quality_rules
from strandlake.llm.secrets_scan import op5_secrets
from strandlake.llm.simhash import op11_simhash
from strandlake.llm.spelling import op13_spelling
from strandlake.llm.substring_dedup import op2_substring_dedup
from strandlake.llm.toxicity import op9_toxicity
from strandlake.llm.url_filter import op8_url_filter

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_pack, op4_quality_rules, op5_secrets, op6_extract, op7_near_duplicates, op8_url_filter, op9_toxicity, op10_quality, op11_simhash, op12_lexical_search, op13_spelling)}

__all__ = ["ORACLE_SQL", "QUERIES"]
