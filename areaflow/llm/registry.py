"""Registered queries of this subpackage and their checking SQL."""

import corpus_pipeline
from areaflow.llm import (exact_dedup, html_wrappers, mixing, oracles, periodic_runs, phrase_index, quality_model, quality_rules,
                          secret_scan, sharding, simhash_links, spelling, token_files, token_tree, word_oracles)

ORACLES = {**oracles.ORACLES, **word_oracles.ORACLES}

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_byte_bpe": token_tree.op3_byte_bpe,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_mixing": mixing.op5_mixing,
    "op6_sharding": sharding.op6_sharding,
    "op7_html_extraction": html_wrappers.op7_html_extraction,
    "op8_token_files": token_files.op8_token_files,
    "op9_simhash": simhash_links.op9_simhash,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_decontamination": phrase_index.op11_decontamination,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
