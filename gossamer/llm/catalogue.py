"""The queries of the corpus operators by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import hamming, jaccard, langid, licenses, mixing, packing, pii, quality, urls, vectors

QUERIES = {
    "op1_additive_pairs": quality.op1_additive_pairs,
    "op2_multi_index": vectors.op2_multi_index,
    "op3_rank_order": langid.op3_rank_order,
    "op4_multi_index_hashing": hamming.op4_multi_index_hashing,
    "op5_markov_ratio": urls.op5_markov_ratio,
    "op6_license_paragraphs": licenses.op6_license_paragraphs,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_bilstm_crf": pii.op8_bilstm_crf,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_mix": mixing.op10_mix,
    # what of an operator SQL can say, where it cannot say all
    "urls_by_rule": urls.urls_by_rule,
    "base_personal_data": pii.base_personal_data,
    "packed_sequences": packing.packed_sequences,
}
ORACLES = {
    "op2_multi_index": vectors.OP2_SQL,
    "op7_jaccard_join": jaccard.OP7_SQL,
    "op10_mix": mixing.OP10_SQL,
    "urls_by_rule": urls.URLS_BY_RULE_SQL,
    "base_personal_data": pii.BASE_SQL,
    "packed_sequences": packing.PACKED_SQL,
}
