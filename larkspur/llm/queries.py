"""The queries of this subpackage, one per operator, and the SQL that mirrors them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embedding_dedup, html, langid, mixing, pii, quality, rules, simhash

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": html.op1_html_text,
        "op2_quality": quality.op2_quality,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_pii": pii.op4_pii,
        "op5_mixing": mixing.op5_mixing,
        "op6_quality_rules": rules.op6_quality_rules,
        "op7_chat_format": chat.op7_chat_format,
        "op8_bpe": bpe.op8_bpe,
        "op9_language_id": langid.op9_language_id,
        "op10_simhash_dedup": simhash.op10_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": embedding_dedup.OP3_SQL, "op6_quality_rules": rules.OP6_SQL}
