"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gaugeworks.llm import axis_search, bpe_codec, code_compression, exact_dedup, lang_id, lattice_lm, packing, quality_rules, repeats, shingle_join, toxicity, url_filter, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lattice_lm": lattice_lm.op3_lattice_lm,
    "op4_bpe_codec": bpe_codec.op4_bpe_codec,
    "op5_packing": packing.op5_packing,
    "op6_lang_id": lang_id.op6_lang_id,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_repeats": repeats.op9_repeats,
    "op10_shingle_join": shingle_join.op10_shingle_join,
    "op11_code_compression": code_compression.op11_code_compression,
    "op12_axis_search": axis_search.op12_axis_search,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_url_filter": url_filter.SQL,
    "op11_code_compression": code_compression.SQL,
}
