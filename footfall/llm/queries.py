"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from footfall.llm import chat, edit_embed, filter_audit, langid, metric_join, minhash, mixing, quality, spiece, suffix_dedup, token_files, turn_repair, warc

QUERIES = {
    "op1_warc_chunks": warc.warc_query,
    "op2_token_files": token_files.tokens_query,
    "op3_sentencepiece": spiece.pieces_query,
    "op4_language_id": langid.langid_query,
    "op5_suffix_dedup": suffix_dedup.suffix_query,
    "op6_minhash_near_dedup": minhash.minhash_query,
    "op7_chat_formatting": chat.chat_query,
    "op8_edit_fingerprints": edit_embed.fingerprint_query,
    "op9_quality_rules": quality.quality_query,
    "op10_mixing": mixing.mix_query,
    "op11_filter_audit": filter_audit.audit_query,
    "op12_turn_repair": turn_repair.repair_query,
    "op13_ngram_jaccard": metric_join.jaccard_query,
}

ORACLE_SQL = {
    "op1_warc_chunks": warc.WARC_SQL,
    "op7_chat_formatting": chat.CHAT_SQL,
    "op10_mixing": mixing.MIX_SQL,
    "op11_filter_audit": filter_audit.AUDIT_SQL,
    "op12_turn_repair": turn_repair.REPAIR_SQL,
}
