"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import collocations, langid, linedup, masked, minhash, neighbours, packing, periods, pieces, quality, substrings, suffixes, urls

QUERIES = {
    "op1_url_words": urls.op1_url_words,
    "op2_multiprobe_neighbours": neighbours.op2_multiprobe_neighbours,
    "op3_masked_likelihood": masked.op3_masked_likelihood,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_line_dedup": linedup.op6_line_dedup,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_minhash_odd_sketch": minhash.op8_minhash_odd_sketch,
    "op9_sampled_pieces": pieces.op9_sampled_pieces,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_tiled_collocations": collocations.op11_tiled_collocations,
    "op12_rank_order_language": langid.op12_rank_order_language,
    "op13_word_runs": periods.op13_word_runs,
}
ORACLES = {
    "op5_suffix_array_dedup": suffixes.OP5_SQL,
    "op6_line_dedup": linedup.OP6_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op8_minhash_odd_sketch": minhash.OP8_SQL,
    "op11_tiled_collocations": collocations.OP11_SQL,
}
