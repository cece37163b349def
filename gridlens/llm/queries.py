"""The queries of this package by name, and SQL where it can express them."""

from __future__ import annotations

from gridlens.llm import chat, collocations, decontaminate, fingerprint, html_text, jaccard, lexical, mixing, tokens, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_html": html_text.op4_html,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_token_files": tokens.op7_token_files,
    "op8_warc": warc.op8_warc,
    "op9_chat": chat.op9_chat,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_collocations": collocations.op11_collocations,
    "op12_lexical": lexical.op12_lexical,
    "op13_url_filter": url_filter.op13_url_filter,
}
SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
