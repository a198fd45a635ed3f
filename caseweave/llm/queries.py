"""Queries and their SQL for the operators of this subpackage."""

from __future__ import annotations

from . import alignment, chat, codes, decontaminate, epsilon, factorization, licenses, mixing, pii, quality, sharding, warc
from .simhash import op1_simhash_near_dedup


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_chat_format": chat.op3_chat_format,
        "op4_pii_surrogates": pii.op4_pii_surrogates,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_sharding": sharding.op6_sharding,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_quality_classifier": factorization.op8_quality_classifier,
        "op9_warc": warc.op9_warc,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_embedding_near_dedup": epsilon.op12_embedding_near_dedup,
        "op13_vector_codes": codes.op13_vector_codes,
    }


def oracle_sql() -> dict:
    return {
        "op2_mixing": mixing.SQL,
        "op6_sharding": sharding.SQL,
        "op7_decontamination": decontaminate.SQL,
        "op9_warc": warc.SQL,
        "op10_quality_rules": quality.SQL,
        "op12_embedding_near_dedup": epsilon.SQL,
        "op13_vector_codes": codes.SQL,
    }
