"""The corpus queries, one for each operator, and their SQL."""

from codegauge.llm.byte_bpe import op8_byte_bpe
from codegauge.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from codegauge.llm.language_id import op9_language_id
from codegauge.llm.merkle import OP11_SQL, op11_merkle_manifest
from codegauge.llm.near_dedup import OP4_SQL, op4_near_dedup
from codegauge.llm.packing import op10_packing
from codegauge.llm.private_data import op13_private_data
from codegauge.llm.quality import op5_quality
from codegauge.llm.ranked_search import OP12_SQL, op12_ranked_search
from codegauge.llm.secret_scan import op7_secret_scan
from codegauge.llm.token_counts import op3_token_counts
from codegauge.llm.token_output import op6_token_output
from codegauge.llm.topk import OP1_SQL, op1_exact_topk

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_token_output": op6_token_output,
    "op7_secret_scan": op7_secret_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_private_data": op13_private_data,
}

ORACLE = {
    "op1_exact_topk": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op4_near_dedup": OP4_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
