"""Queries of this subpackage and their SQL, for the registry at the repository top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import (
    conversation_repair,
    decontamination,
    license_scan,
    near_dedup,
    packing,
    private_terms,
    quality_model,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity,
    whitening,
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_packing": packing.query,
        "op3_toxicity": toxicity.query,
        "op4_decontamination": decontamination.query,
        "op5_sharding": sharding.query,
        "op6_near_dedup": near_dedup.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_license_scan": license_scan.query,
        "op9_suffix_dedup": suffix_dedup.query,
        "op10_quality_model": quality_model.query,
        "op11_private_terms": private_terms.query,
        "op12_conversation_repair": conversation_repair.query,
        "op13_embedding_whitening": whitening.query,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op4_decontamination": decontamination.ORACLE,
        "op6_near_dedup": near_dedup.ORACLE,
        "op7_substring_dedup": substring_dedup.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
    }
