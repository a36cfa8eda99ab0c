"""Queries of this subpackage by name, with DuckDB SQL where it can express them."""

from tracewright.llm import conversation_trie, decontaminate, hard_negatives, language_id, lm_score, packing, pii_crf, piece_codec, secret_scan, simhash_dedup, token_counts, toxicity, vector_dedup

QUERIES = {
    "op1_vector_dedup": vector_dedup.op1_vector_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_pii_crf": pii_crf.op4_pii_crf,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_piece_codec": piece_codec.op7_piece_codec,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_prefix_trie": conversation_trie.op11_prefix_trie,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}

OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0),
pairs AS (SELECT a.r, a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.95),
edges AS (SELECT DISTINCT u, w FROM pairs WHERE u <> w),
reach(id, node) AS (SELECT DISTINCT vec_id, vec_id FROM v UNION SELECT r.id, p.w FROM reach r JOIN edges p ON p.u = r.node),
comp AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id),
deg AS (SELECT r, count(*) AS n FROM pairs GROUP BY r)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN deg ON deg.r = v.r JOIN comp ON comp.id = v.vec_id
"""

ORACLES = {"op1_vector_dedup": OP1_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op11_prefix_trie": conversation_trie.OP11_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
