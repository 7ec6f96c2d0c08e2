"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, html_extract, jaccard, lm_compress, media, packing, quality_fm, quality_rules, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_chat": chat.op3_chat,
    "op4_quality": quality_fm.op4_quality,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_lm_score": lm_compress.op7_lm_score,
    "op8_bpe": bpe.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_media": media.op10_media,
}
ORACLE = {"op3_chat": chat.SQL, "op5_jaccard_join": jaccard.SQL}
