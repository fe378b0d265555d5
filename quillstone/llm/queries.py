"""The queries of the operators and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, jaccard_join, langid, licences, media, mixing, pii, suffix_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language": langid.op2_language,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat": chat.op6_chat,
    "op7_media": media.op7_media,
    "op8_licences": licences.op8_licences,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE_SQL = decontaminate.ORACLE_SQL | mixing.ORACLE_SQL | chat.ORACLE_SQL | licences.ORACLE_SQL | suffix_dedup.ORACLE_SQL | jaccard_join.ORACLE_SQL
