"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from strataspan.llm import byte_bpe, chat, decontam, html_text, line_dedup, ngram_join, pitman_yor, quality, repair_ids, topk

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_chat_format": chat.op7_chat_format,
    "op8_topk_search": topk.op8_topk_search,
    "op9_token_shards": repair_ids.op9_token_shards,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
}

ORACLES = {
    "op2_ngram_jaccard_join": ngram_join.OP2_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_topk_search": topk.OP8_SQL,
}
