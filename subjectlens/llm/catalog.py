"""Named queries of the corpus operators and their SQL."""

from __future__ import annotations

from subjectlens.llm import best_fit, chat_tree, decontaminate, divergence, exact_dedup, html_extract, lm_score, mixing, periodic_runs, simhash, token_files, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_warc": warc.op4_warc,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_files": token_files.op7_token_files,
    "op8_chat_tree": chat_tree.op8_chat_tree,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_best_fit_packing": best_fit.op13_best_fit_packing,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_chat_tree": chat_tree.OP8_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
