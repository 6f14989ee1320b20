"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, jaccard_join, langid, oracles, pii, quality, suffix_dedup, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_urlfilter": urlfilter.op2_urlfilter,
    "op3_bpe": bpe.op3_bpe,
    "op4_warc": warc.op4_warc,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_langid": langid.op7_langid,
    "op8_pii": pii.op8_pii,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracles.OP1,
    "op2_urlfilter": urlfilter.OP2_SQL,
    "op5_jaccard_join": oracles.OP5,
    "op9_suffix_dedup": oracles.OP9,
}
