"""The registered queries of this package, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_guard.llm import (
    chat,
    decontaminate,
    jaccard,
    language,
    lattice,
    licence,
    mixing,
    quality,
    simhash,
    spelling,
    toxicity,
    url_filter,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": language.op1,
    "op2_mixing": mixing.op2,
    "op3_licence_scan": licence.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_decontamination": decontaminate.op5,
    "op6_simhash": simhash.op6,
    "op7_chat_format": chat.op7,
    "op8_toxicity": toxicity.op8,
    "op9_url_filter": url_filter.op9,
    "op10_quality": quality.op10,
    "op11_lattice_score": lattice.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
