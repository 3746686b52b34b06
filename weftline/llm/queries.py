"""The queries that apply each training-data operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import jaccard, langid, media, mixing, pieces, pii, quality, substrings, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": pieces.op1_sentencepiece, "op2_topk": topk.op2_topk, "op3_media": media.op3_media, "op4_toxicity": toxicity.op4_toxicity, "op5_pii": pii.op5_pii, "op6_repeats": substrings.op6_repeats, "op7_quality": quality.op7_quality, "op8_langid": langid.op8_langid, "op9_jaccard_join": jaccard.op9_jaccard_join, "op10_mixing": mixing.op10_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.SQL, "op9_jaccard_join": jaccard.SQL, "op10_mixing": mixing.SQL}
