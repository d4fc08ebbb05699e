"""The subpackage's queries and SQL, by name."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, lm_scoring, minhash, packing, pii, quality, sharding, substring_dedup


def queries() -> dict:
    return {
        "op1_feistel_shards": sharding.op1_feistel_shards,
        "op2_near_duplicates": minhash.op2_near_duplicates,
        "op2_weighted_near_duplicates": minhash.op2_weighted_near_duplicates,
        "op3_repeated_words": substring_dedup.op3_repeated_words,
        "op4_packed_sequences": packing.op4_packed_sequences,
        "op5_personal_data": pii.op5_personal_data,
        "op6_language_id": language_id.op6_language_id,
        "op6_page_languages": language_id.op6_page_languages,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_quality_scores": quality.op8_quality_scores,
        "op9_contaminated": decontaminate.op9_contaminated,
        "op10_lattice_scores": lm_scoring.op10_lattice_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_feistel_shards": sharding.OP1_SQL,
        "op2_near_duplicates": minhash.OP2_SQL,
        "op2_weighted_near_duplicates": minhash.OP2_WEIGHTED_SQL,
        "op3_repeated_words": substring_dedup.OP3_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op9_contaminated": decontaminate.OP9_SQL,
    }
