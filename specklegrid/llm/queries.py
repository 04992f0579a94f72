"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_format
from .curve_search import op7_curve_search
from .dialogue_repair import OP11_SQL, op11_dialogue_repair
from .filter_audit import OP13_SQL, op13_filter_audit
from .fingerprints import op10_fingerprints
from .language_id import op3_language_id
from .ngram_join import op1_ngram_jaccard_join
from .packing import op12_packing
from .sentence_pieces import op6_sentencepiece
from .source_mixing import OP4_SQL, op4_source_mixing
from .substring_dedup import op5_substring_dedup
from .suffix_dedup import op8_suffix_array_dedup
from .token_counts import op9_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_chat_format, op3_language_id, op4_source_mixing, op5_substring_dedup, op6_sentencepiece, op7_curve_search, op8_suffix_array_dedup, op9_token_counts, op10_fingerprints, op11_dialogue_repair, op12_packing, op13_filter_audit)
}
ORACLE_SQL = {"op2_chat_format": OP2_SQL, "op4_source_mixing": OP4_SQL, "op11_dialogue_repair": OP11_SQL, "op13_filter_audit": OP13_SQL}
