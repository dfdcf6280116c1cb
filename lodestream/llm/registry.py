"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestream.llm import op1_fingerprints as op1
from lodestream.llm import op2_sharding as op2
from lodestream.llm import op3_parity_join as op3
from lodestream.llm import op4_packing as op4
from lodestream.llm import op5_mixing as op5
from lodestream.llm import op6_urls as op6
from lodestream.llm import op7_language as op7
from lodestream.llm import op8_suffix_dedup as op8
from lodestream.llm import op9_warc as op9
from lodestream.llm import op10_topk as op10

QUERIES = {
    "op1_fingerprints": op1.op1_fingerprints,
    "op2_sharding": op2.op2_sharding,
    "op3_parity_join": op3.op3_parity_join,
    "op4_packing": op4.op4_packing,
    "op5_mixing": op5.op5_mixing,
    "op6_urls": op6.op6_urls,
    "op7_language": op7.op7_language,
    "op8_suffix_dedup": op8.op8_suffix_dedup,
    "op9_warc": op9.op9_warc,
    "op10_topk": op10.op10_topk,
}
SQL = {"op2_sharding": op2.SQL, "op5_mixing": op5.SQL, "op9_warc": op9.SQL, "op10_topk": op10.SQL}
