"""The registered queries of the corpus operators and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from cadence.llm import q_lines, q_mixing, q_near, q_text, q_tokens, q_vectors, q_words
from cadence.llm.common import shipped

QUERIES = {
    "op1_token_records": q_tokens.op1_token_records,
    "op2_mix_sources": q_mixing.op2_mix_sources,
    "op3_substring_dedup": q_near.op3_substring_dedup,
    "op4_pii": q_text.op4_pii,
    "op5_minhash": q_near.op5_minhash,
    "op6_line_dedup": q_lines.op6_line_dedup,
    "op7_pieces": q_tokens.op7_pieces,
    "op8_language": q_text.op8_language,
    "op9_top_k": q_vectors.op9_top_k,
    "op10_embedding_dedup": q_vectors.op10_embedding_dedup,
    "op11_spelling": q_words.op11_spelling,
    "op12_hard_negatives": q_vectors.op12_hard_negatives,
    "op13_secrets": q_text.op13_secrets,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE_SQL = {
    "op2_mix_sources": q_mixing.SQL,
    "op5_minhash": q_near.NEAR_SQL,
    "op6_line_dedup": q_lines.SQL,
    "op9_top_k": q_vectors.TOP_K_SQL,
    "op10_embedding_dedup": q_vectors.NEAR_SQL,
    "op11_spelling": q_words.SQL,
    "op12_hard_negatives": q_vectors.HARD_SQL,
    "op13_secrets": q_text.SECRETS_SQL,
}
