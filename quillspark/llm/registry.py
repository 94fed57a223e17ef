"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from .cross_tokens import op11_cross_tokens
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_extract import op4_html_extract
from .language_id import op6_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import op10_ngram_join
from .packing import op2_packing
from .sharding import op9_sharding
from .substring_dedup import op7_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .suffix_tree import op12_lm_scoring
from .topk_search import OP1_SQL, op1_topk_search


def queries() -> dict:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_packing": op2_packing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_html_extract": op4_html_extract,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_sharding": op9_sharding,
        "op10_ngram_join": op10_ngram_join,
        "op11_cross_tokens": op11_cross_tokens,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op5_mixing": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op13_lexical_search": OP13_SQL}
