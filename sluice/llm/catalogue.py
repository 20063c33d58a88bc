"""The queries of this subpackage but for the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from sluice.llm import centroids, context_trees, embeddings_classifier, hnsw, jaccard, licenses, lines, mixing, packing, prefix_trie, quality_rules, sharding, warc

QUERIES = {
    "op1_warc_dictionary": warc.query,
    "op2_license_scan": licenses.query,
    "op3_ngram_jaccard_join": jaccard.query,
    "op4_hnsw_neighbours": hnsw.query,
    "op5_packing": packing.query,
    "op6_virtual_slots": sharding.query,
    "op7_line_chunks": lines.query,
    "op8_sainte_lague_mix": mixing.query,
    "op9_subword_quality": embeddings_classifier.query,
    "op10_quality_rules": quality_rules.query,
    "op11_heap_clusters": centroids.query,
    "op12_context_trees": context_trees.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLES: dict[str, str] = {
    "op1_warc_dictionary": warc.ORACLE, "op3_ngram_jaccard_join": jaccard.ORACLE, "op11_heap_clusters": centroids.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE,
}
