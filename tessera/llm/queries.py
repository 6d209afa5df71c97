"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import decontaminate, html_extract, jaccard, license_scan, lm_score, sentencepiece, sharding, topk, toxicity, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_warc": warc.op2_warc,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_html": html_extract.op4_html,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_sentencepiece": sentencepiece.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_topk": topk.op9_topk,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_jaccard": jaccard.OP3_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
