"""Queries and SQL of the text operators, for the entry module."""

from __future__ import annotations

from platen.llm.exact_dedup import OP2_SQL, op2_query
from platen.llm.jaccard_join import op4_query
from platen.llm.language import op3_query
from platen.llm.licenses import OP7_SQL, op7_query
from platen.llm.mixing import OP6_SQL, op6_query
from platen.llm.packing import op8_query
from platen.llm.pseudonyms import op10_query
from platen.llm.shards import OP9_SQL, op9_query
from platen.llm.suffix_dedup import op1_query
from platen.llm.topk import OP5_SQL, op5_query

QUERIES = {
    "op1_suffix_dedup": op1_query,
    "op2_exact_dedup": op2_query,
    "op3_language": op3_query,
    "op4_jaccard_join": op4_query,
    "op5_topk": op5_query,
    "op6_mix_sources": op6_query,
    "op7_licenses": op7_query,
    "op8_pack": op8_query,
    "op9_shards": op9_query,
    "op10_pseudonyms": op10_query,
}

SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op5_topk": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_licenses": OP7_SQL,
    "op9_shards": OP9_SQL,
}
