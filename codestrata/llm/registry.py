"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from codestrata.llm import bm25, chat_format, decontaminate, lm_scoring, minhash, mixing, pii, secret_scan, sharding, toxicity


def queries():
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_pii": pii.op4_pii,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_topk": bm25.op8_topk,
        "op9_sharding": sharding.op9_sharding,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql():
    return {
        "op2_chat_format": chat_format.SQL,
        "op3_decontaminate": decontaminate.SQL,
        "op8_topk": bm25.SQL,
        "op9_sharding": sharding.SQL,
        "op10_minhash": minhash.SQL,
    }
