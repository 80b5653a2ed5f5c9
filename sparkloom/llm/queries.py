"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from sparkloom.llm import exact_dedup, jaccard_join, language_id, mixing, ppm_scoring, sentencepiece_codec, substring_dedup, token_counts, topk_search, zip_warc

QUERIES = {
    "op1_topk": topk_search.op1_topk,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_warc": zip_warc.op3_warc,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_jaccard": jaccard_join.op8_jaccard,
    "op9_ppm": ppm_scoring.op9_ppm,
    "op10_mixing": mixing.op10_mixing,
}
SQL = {"op1_topk": topk_search.SQL, "op2_substring_dedup": substring_dedup.SQL, "op3_warc": zip_warc.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_jaccard": jaccard_join.SQL, "op10_mixing": mixing.SQL}
