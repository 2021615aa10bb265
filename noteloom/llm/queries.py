"""Registered queries of this subpackage and, where SQL can express them,
their SQL."""

from __future__ import annotations

from noteloom.llm.ann_search import op10_ann_search
from noteloom.llm.packing import op7_packing
from noteloom.llm.quality import op5_quality
from noteloom.llm.sentencepiece_sampling import op6_sentencepiece_sampling
from noteloom.llm.simhash import op3_simhash_near_dedup
from noteloom.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from noteloom.llm.token_file import op9_token_file
from noteloom.llm.topk_search import OP2_SQL, op2_topk_search
from noteloom.llm.toxicity import op8_toxicity
from noteloom.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_topk_search,
        op3_simhash_near_dedup,
        op4_url_filter,
        op5_quality,
        op6_sentencepiece_sampling,
        op7_packing,
        op8_toxicity,
        op9_token_file,
        op10_ann_search,
    )
}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op2_topk_search": OP2_SQL, "op4_url_filter": OP4_SQL}
