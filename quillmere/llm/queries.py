"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillmere.llm.flac import op3_flac
from quillmere.llm.jaccard import op10_jaccard_join
from quillmere.llm.langid import op1_langid
from quillmere.llm.mixing import MIX_SQL, op5_poisson_mix
from quillmere.llm.packing import op4_pack
from quillmere.llm.pii import op2_pii
from quillmere.llm.quality import op8_quality
from quillmere.llm.suffix import op9_drop_repeats
from quillmere.llm.urls import URL_SQL, op7_url_filter
from quillmere.llm.vectors import VECTOR_SQL, op6_vector_links

QUERIES = {
    "op1_langid": op1_langid,
    "op2_pii": op2_pii,
    "op3_flac": op3_flac,
    "op4_pack": op4_pack,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_vector_links": op6_vector_links,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_drop_repeats": op9_drop_repeats,
    "op10_jaccard_join": op10_jaccard_join,
}
ORACLE_SQL = {"op5_poisson_mix": MIX_SQL, "op6_vector_links": VECTOR_SQL, "op7_url_filter": URL_SQL}
