"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, chat, clustering, exact_dedup, html_extract, licenses, minhash, mixing, prefix_trie, sentencepieces, stupid_backoff, token_counts, toxicity

QUERIES = {
    "op1_posting_list_search": ann.op1_posting_list_search,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_stupid_backoff": stupid_backoff.op3_stupid_backoff,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_bpe_token_counts": token_counts.op8_bpe_token_counts,
    "op9_sentencepiece": sentencepieces.op9_sentencepiece,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_html_extraction": html_extract.op12_html_extraction,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}

#: DuckDB SQL, where SQL expresses the operator.
ORACLES = {
    "op3_stupid_backoff": stupid_backoff.ORACLE,
    "op2_minhash_near_dedup": minhash.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_license_scan": licenses.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_centroid_clustering": clustering.ORACLE,
}
