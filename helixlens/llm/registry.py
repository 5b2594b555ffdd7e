"""The registered queries of the document operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_secrets": secrets.op10_secrets,
}

SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_near_dedup": near_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op6_line_dedup": line_dedup.SQL,
}
