"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown_lm, divergence, licenses, mixing, near_dedup, quality, search, sentencepiece_bpe, sharding, suffix_dedup, toxicity, warc, winnowing

QUERIES = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_mixing": mixing.op2_mixing,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_brown_lm": brown_lm.op4_brown_lm,
    "op6_licenses": licenses.op6_licenses,
    "op7_sentencepiece": sentencepiece_bpe.op7_sentencepiece,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op5_sharding": sharding.op5_sharding,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_divergence": divergence.op12_divergence,
    "op13_search": search.op13_search,
}
ORACLES: dict = {"op6_licenses": licenses.oracle(), "op8_warc": warc.OP8_SQL, "op10_quality": quality.OP10_SQL, "op12_divergence": divergence.OP12_SQL, "op13_search": search.OP13_SQL}
