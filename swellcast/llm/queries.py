"""Queries of this package and their SQL, for the driver's registry."""

from __future__ import annotations

from swellcast.llm import (
    decontaminate, exact_dedup, jaccard, mixing_lm, nearest, page_text, pii, quality, ranked_search, secret_scan,
    sentencepiece_codec, wavelet, word_runs,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_pii": pii.op6_pii,
    "op7_page_text": page_text.op7_page_text,
    "op8_wavelet": wavelet.op8_wavelet,
    "op9_mixing_lm": mixing_lm.op9_mixing_lm,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_nearest": nearest.op11_nearest,
    "op12_word_runs": word_runs.op12_word_runs,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES = {"op5_exact_dedup": exact_dedup.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
