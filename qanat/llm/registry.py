"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from qanat.llm import ball_kmeans, chunking, decontamination, hmm, langid, mixing, near_dup, periodic_runs, quality_rules, sharding, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_chunked_media": chunking.op1_chunked_media,
    "op10_hmm_scores": hmm.op10_hmm_scores,
    "op11_isolation_quality": quality_rules.op11_isolation_quality,
    "op12_ball_kmeans": ball_kmeans.op12_ball_kmeans,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "op2_rendezvous_sharding": sharding.op2_rendezvous_sharding,
    "op3_language_id": langid.op3_language_id,
    "op4_probminhash_near_dup": near_dup.op4_probminhash_near_dup,
    "op5_fm_substring_dedup": substring_dedup.op5_fm_substring_dedup,
    "op6_qgram_decontamination": decontamination.op6_qgram_decontamination,
    "op7_token_files": token_files.op7_token_files,
    "op8_sainte_lague_mix": mixing.op8_sainte_lague_mix,
    "op9_ftrl_toxicity": toxicity.op9_ftrl_toxicity,
}

ORACLE_SQL = {
    "op12_ball_kmeans": ball_kmeans.OP12_SQL,
    "op5_fm_substring_dedup": substring_dedup.OP5_SQL,
    "op8_sainte_lague_mix": mixing.OP8_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
