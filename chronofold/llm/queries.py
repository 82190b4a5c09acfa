"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from chronofold.llm import exact_dedup, lines, media, mixing, near_dedup, oracles, packing, quality, secrets, sharding, substrings

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media": media.op2_media,
    "op3_secrets": secrets.op3_secrets,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_suffix_dedup": substrings.op6_suffix_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
SQL = {
    "op1_mixing": mixing.SQL,
    "op3_secrets": secrets.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": oracles.LINES,
    "op6_suffix_dedup": oracles.SUBSTRINGS,
    "op10_near_dedup": oracles.NEAR,
}
