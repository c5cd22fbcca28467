"""All queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import q_audio, q_centroids, q_collocations, q_decontaminate, q_html, q_langid, q_mixing, q_ngram_join, q_sharding, q_spans, q_token_counts, q_token_store, q_top_inner

MODULES = [q_langid, q_audio, q_token_counts, q_spans, q_sharding, q_token_store, q_html, q_mixing, q_ngram_join, q_decontaminate, q_centroids, q_top_inner, q_collocations]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
