"""Queries of the operators of this subpackage, and the SQL of those that SQL can express."""

from pitrank.llm import op10_quality_classifier, op11_lexical_search, op12_topk_search, op13_periodic_runs, op1_substring_dedup, op2_decontamination, op3_lm_scoring, op4_token_counts, op5_pii, op6_quality_rules, op7_sentencepiece, op8_line_dedup, op9_ngram_join

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup.op1_substring_dedup,
    "op2_decontamination": op2_decontamination.op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring.op3_lm_scoring,
    "op4_token_counts": op4_token_counts.op4_token_counts,
    "op5_pii": op5_pii.op5_pii,
    "op6_quality_rules": op6_quality_rules.op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece.op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup.op8_line_dedup,
    "op9_ngram_join": op9_ngram_join.op9_ngram_join,
    "op10_quality_classifier": op10_quality_classifier.op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search.op11_lexical_search,
    "op12_topk_search": op12_topk_search.op12_topk_search,
    "op13_periodic_runs": op13_periodic_runs.op13_periodic_runs,
}
ORACLE_SQL = {
    "op1_substring_dedup": op1_substring_dedup.ORACLE_SQL,
    "op2_decontamination": op2_decontamination.ORACLE_SQL,
    "op8_line_dedup": op8_line_dedup.ORACLE_SQL,
    "op9_ngram_join": op9_ngram_join.ORACLE_SQL,
    "op11_lexical_search": op11_lexical_search.ORACLE_SQL,
    "op12_topk_search": op12_topk_search.ORACLE_SQL,
    "op13_periodic_runs": op13_periodic_runs.ORACLE_SQL,
}
