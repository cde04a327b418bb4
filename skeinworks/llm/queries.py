"""Registered queries of the corpus operators and the SQL that some of them equal."""

from .bpe import op6_byte_bpe
from .centroids import OP11_SQL, op11_annulus_clusters
from .codes import OP12_SQL, op12_vector_codes
from .ctph import op2_fingerprint
from .language_id import op1_language_id
from .line_quality import OP7_SQL, op7_line_quality
from .neardup import OP8_SQL, op8_minmax_neardup
from .packing import op9_packing
from .pages import op10_main_text
from .repeats import OP5_SQL, op5_repeats
from .suffixes import OP13_SQL, op13_suffix_array
from .toxicity import op3_toxicity
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprint": op2_fingerprint,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_repeats": op5_repeats,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_quality": op7_line_quality,
    "op8_minmax_neardup": op8_minmax_neardup,
    "op9_packing": op9_packing,
    "op10_main_text": op10_main_text,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_array": op13_suffix_array,
}

ORACLE = {
    "op4_url_filter": OP4_SQL,
    "op5_repeats": OP5_SQL,
    "op7_line_quality": OP7_SQL,
    "op8_minmax_neardup": OP8_SQL,
    "op11_annulus_clusters": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_suffix_array": OP13_SQL,
}
