"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from framelake.llm import alignment, ctw, decontaminate, jaccard_join, lexical_search, line_dedup, packing, pii, quality, substring_dedup, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_ctw": ctw.op4_ctw,
    "op5_quality": quality.op5_quality,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
    "op11_alignment": alignment.op11_alignment,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op1_warc": warc.SQL,
    "op2_url_filters": url_filters.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_suffix_dedup": suffix_dedup.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
