"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .centroids import OP12_SQL, op12_drake_clusters
from .chat import OP5_SQL, op5_chat_formatting
from .circulant import OP11_SQL, op11_circulant_minhash
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .media import op2_media_columns
from .ngram_join import op8_ngram_jaccard_join
from .packing import op1_packing
from .secrets import op6_secret_scans
from .spelling import OP13_SQL, op13_spelling_variants
from .toxicity import op4_toxicity
from .url_filter import op3_url_filters
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_media_columns": op2_media_columns,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_secret_scans": op6_secret_scans,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_warc": op9_warc,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_drake_clusters": op12_drake_clusters,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Those that SQL can express; the tests hold the others against brute force, a round trip or held-out rows.
ORACLE_SQL = {
    "op5_chat_formatting": OP5_SQL,
    "op9_warc": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_circulant_minhash": OP11_SQL,
    "op12_drake_clusters": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
