"""The registered queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .clusters import OP11_SQL, op11
from .decontaminate import OP3_SQL, op3
from .embedding_dedup import OP7_SQL, op7
from .html_extract import op5
from .line_dedup import OP12_SQL, op12
from .packing import op2
from .quality import op6
from .search import OP13_SQL, op13
from .simhash import op9
from .token_counts import op4
from .token_files import op10
from .toxicity import op1
from .warc import OP8_SQL, op8

QUERIES = {
    "op1_toxicity": op1,
    "op2_packing": op2,
    "op3_benchmark_decontamination": op3,
    "op4_token_counts": op4,
    "op5_html_extraction": op5,
    "op6_quality": op6,
    "op7_embedding_near_dedup": op7,
    "op8_warc": op8,
    "op9_simhash_near_dedup": op9,
    "op10_token_files": op10,
    "op11_centroid_clusters": op11,
    "op12_line_dedup": op12,
    "op13_ranked_search": op13,
}

ORACLE_SQL = {
    "op3_benchmark_decontamination": OP3_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_line_dedup": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
