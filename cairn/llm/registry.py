"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from cairn.llm import archives, decontaminate, language, line_rules, mixing, near_dup, phrases, quality, secrets, sharding


def queries() -> dict:
    """Name to query(spark, sf_dir)."""
    return {
        "op1_hash_tree_sharding": sharding.op1_hash_tree_sharding,
        "op2_language_evidence": language.op2_language_evidence,
        "language_of_pages": language.language_of_pages,
        "op3_repeated_phrase_automata": phrases.op3_repeated_phrase_automata,
        "op4_sainte_lague_mix": mixing.op4_sainte_lague_mix,
        "op5_forest_secret_scan": secrets.op5_forest_secret_scan,
        "op6_ftrl_quality": quality.op6_ftrl_quality,
        "op7_latent_decontamination": decontaminate.op7_latent_decontamination,
        "op8_line_frequency_rules": line_rules.op8_line_frequency_rules,
        "op9_hyperminhash_near_dup": near_dup.op9_hyperminhash_near_dup,
        "op10_warc_index_merge": archives.op10_warc_index_merge,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {
        "op1_hash_tree_sharding": sharding.sql_op1(),
        "op4_sainte_lague_mix": mixing.sql_op4(),
        "op8_line_frequency_rules": line_rules.sql_op8(),
        "op10_warc_index_merge": archives.sql_op10(),
    }
