"""The queries of the corpus operators and the SQL that DuckDB can run for them."""

from __future__ import annotations

from runloom.llm import ann, audit, chat, exact_dedup, language, lines, lm, mixing, phrases, pieces, quality, simhash, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_nearest_neighbours": ann.op2_nearest_neighbours,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "mixing_targets": mixing.mixing_targets,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_lm_scoring": lm.op13_lm_scoring,
    "lm_base_scores": lm.lm_base_scores,
}

ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op12_filter_audit": audit.OP12_SQL,
    "lm_base_scores": lm.BASE_SQL,
}
