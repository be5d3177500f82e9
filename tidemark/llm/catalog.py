"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm import (decontaminate, html_text, kneser_ney, lexical_search, line_dedup, packing, prefix_trie,
                          quality_rules, simhash, superminhash, token_files, url_rules, warc)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_kneser_ney": kneser_ney.op4_kneser_ney,
    "op5_packing": packing.op5_packing,
    "op6_html_text": html_text.op6_html_text,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_warc": warc.op9_warc,
    "op10_token_files": token_files.op10_token_files,
    "op11_superminhash": superminhash.op11_superminhash,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {"op8_url_rules": url_rules.SQL, "op9_warc": warc.SQL,
       "op12_prefix_trie": prefix_trie.SQL, "op13_lexical_search": lexical_search.SQL}
