"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from callbook.llm import decontaminate, jaccard, langid, line_dedup, lm_score, nearest, packing, pieces, pii, runs, token_counts, toxicity, whitening

QUERIES = {"op1_line_dedup": line_dedup.query, "op2_nearest": nearest.query, "op3_lm_score": lm_score.query, "op4_sentencepiece": pieces.query, "op5_jaccard_join": jaccard.query, "op6_language_id": langid.query, "op7_decontamination": decontaminate.query, "op8_toxicity": toxicity.query, "op9_token_counts": token_counts.query, "op10_pii": pii.query, "op11_whitening": whitening.query, "op12_periodic_runs": runs.query, "op13_best_fit_packing": packing.query}
ORACLE_SQL = {"op1_line_dedup": line_dedup.SQL}
