"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from envgrid.llm import alignment, decontam, html_text, lines, media, near, packing, pieces_bpe, prefix_trie, quality, repeats, token_counts, toxicity

QUERIES = {}
ORACLES = {}
for _m in (pieces_bpe, media, quality, token_counts, toxicity, html_text, lines, packing, near, repeats, decontam, prefix_trie, alignment):
    QUERIES |= _m.QUERIES
    ORACLES |= getattr(_m, "ORACLES", {})
