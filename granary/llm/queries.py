"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprints, line_dedup, lm, media, minhash, mixing, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_lm": lm.op2_lm,
    "op3_minhash": minhash.op3_minhash,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_media": media.op6_media,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_spotsigs": fingerprints.op10_spotsigs,
}
SQL = {"op1_url_filter": url_filter.SQL, "op5_line_dedup": line_dedup.SQL, "op9_mixing": mixing.SQL}
