"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import licenses, line_dedup, media, mixing, near_dedup, packing, pipeline, quality_model, quality_rules, sharding, sql, tokens


def queries():
    return {
        "op1_media": media.op1_media,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality_classifier": quality_model.op9_quality_classifier,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {
        "op3_quality_rules": sql.OP3,
        "op7_line_dedup": sql.OP7,
        "op10_near_dedup": sql.OP10,
    }
