"""Queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from .bpe import op5_bpe
from .classlm import op7_class_lm
from .jaccard import OP9_SQL, op9_jaccard_join
from .langid import op4_language_id
from .lexical import OP11_SQL, op11_lexical_search
from .lines import OP8_SQL, op8_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .negatives import OP12_SQL, op12_hard_negatives
from .neighbours import op2_neighbours
from .packing import op13_packing
from .spotsigs import op1_spotsigs
from .substring import OP3_SQL, op3_substring_dedup
from .suffixes import op10_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_spotsigs, op2_neighbours, op3_substring_dedup, op4_language_id, op5_bpe, op6_mixing, op7_class_lm, op8_line_dedup, op9_jaccard_join, op10_suffix_dedup, op11_lexical_search, op12_hard_negatives, op13_packing)}
ORACLE_SQL = {"op3_substring_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
