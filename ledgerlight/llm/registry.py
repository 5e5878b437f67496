"""Registered corpus queries and their DuckDB equivalents."""

from __future__ import annotations

from ledgerlight.llm import (alignment, exact_dedup, html_text, line_dedup, neighbours, packing, periodic_runs, quality,
                             quality_rules, sentencepiece_bpe, sharding, simhash, token_shards)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_packing": packing.query,
    "op3_quality": quality.query,
    "op4_sentencepiece": sentencepiece_bpe.query,
    "op5_neighbours": neighbours.query,
    "op6_html_text": html_text.query,
    "op7_sharding": sharding.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_token_shards": token_shards.query,
    "op10_simhash": simhash.query,
    "op11_quality_rules": quality_rules.query,
    "op12_alignment": alignment.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE = {
    "op8_exact_dedup": exact_dedup.SQL,
}
