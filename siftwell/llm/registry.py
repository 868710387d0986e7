"""The queries of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline

from . import classifier, decontamination, licenses, ngram_join, pieces, rules, suffix_dedup, token_counts, token_files, url_filters

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_classifier": classifier.op1_quality_classifier,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_token_binary": token_files.op4_token_binary,
    "op5_ngram_jaccard": ngram_join.op5_ngram_jaccard,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": rules.op10_quality_rules,
}
ORACLE_SQL = {"op5_ngram_jaccard": ngram_join.OP5_SQL, "op2_url_filters": url_filters.OP2_SQL, "op10_quality_rules": rules.OP10_SQL}
