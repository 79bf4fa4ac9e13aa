"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from blockalloc.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from blockalloc.llm.html_text import op9_main_text
from blockalloc.llm.language_model import op7_lm_score
from blockalloc.llm.lexical import OP11_SQL, op11_lexical_search
from blockalloc.llm.mixing import OP12_SQL, op12_source_mix
from blockalloc.llm.packing import op6_packing
from blockalloc.llm.quality import op10_quality
from blockalloc.llm.resampling import op13_importance_resampling
from blockalloc.llm.simhash import op4_simhash
from blockalloc.llm.substrings import OP3_SQL, op3_suffix_dedup
from blockalloc.llm.tokens import op8_byte_bpe
from blockalloc.llm.topk import OP1_SQL, op1_top_k
from blockalloc.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_main_text": op9_main_text,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_mix": op12_source_mix,
    "op13_importance_resampling": op13_importance_resampling,
}
SQL = {"op1_top_k": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op11_lexical_search": OP11_SQL, "op12_source_mix": OP12_SQL}
