"""The registered queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlens.llm import (
    bpe, chat, language, lloyd, minhash, mixing, neighbours, pii, repeats, runs, shards, topk, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": chat.op1_chat,
    "op2_shards": shards.op2_shards,
    "op3_minhash": minhash.op3_minhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_repeats": repeats.op7_repeats,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_topk": topk.op10_topk,
    "op11_clusters": lloyd.op11_clusters,
    "op12_language": language.op12_language,
    "op13_runs": runs.op13_runs,
}
SQL: dict[str, str] = {
    "op1_chat": chat.SQL, "op3_minhash": minhash.SQL, "op4_mixing": mixing.SQL, "op7_repeats": repeats.SQL,
    "op8_neighbours": neighbours.SQL, "op10_topk": topk.SQL, "op11_clusters": lloyd.SQL,
}
