"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from . import bpe_table, conversation_trie, decontaminate, exact_dedup, html_text, license_scan, line_dedup, near_dedup, repeat_spans, token_align, token_records, toxicity, web_archive

QUERIES = {
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op10_html_text": html_text.op10_html_text,
    "op5_license_scan": license_scan.op5_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op6_web_archive": web_archive.op6_web_archive,
    "op7_minhash_dedup": near_dedup.op7_minhash_dedup,
    "op3_bpe_table": bpe_table.op3_bpe_table,
    "op1_token_records": token_records.op1_token_records,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op11_token_align": token_align.op11_token_align,
    "op12_repeat_spans": repeat_spans.op12_repeat_spans,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLE_SQL = {
    "op5_license_scan": license_scan.OP5_SQL,
    "op6_web_archive": web_archive.OP6_SQL,
    "op7_minhash_dedup": near_dedup.OP7_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
