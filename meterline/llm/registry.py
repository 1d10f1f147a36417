"""Registered queries of this subpackage and their SQL twins."""

from . import conversations, fingerprint, language, mixing, near_duplicates, neighbours, periodic_runs, quality, sentence_pieces, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.query,
    "op2_mixing": mixing.query,
    "op3_language": language.query,
    "op4_token_counts": token_counts.query,
    "op5_fingerprint": fingerprint.query,
    "op6_neighbours": neighbours.query,
    "op7_sentence_pieces": sentence_pieces.query,
    "op8_url_filter": url_filter.query,
    "op9_near_duplicates": near_duplicates.query,
    "op10_toxicity": toxicity.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_substring_dedup": substring_dedup.query,
    "op13_conversations": conversations.query,
}

SQL = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op6_neighbours": neighbours.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op9_near_duplicates": near_duplicates.ORACLE_SQL,
    "op12_substring_dedup": substring_dedup.ORACLE_SQL,
}
