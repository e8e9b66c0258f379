"""Registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from codeloom.llm import ann, chat, decontaminate, divergence, langid, licenses, lm, mixing, neardup, ranked, toxicity, urlrules, veccodes

QUERIES = {
    "op1_lm_scoring": lm.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_language_id": langid.op3,
    "op4_chat_formatting": chat.op4,
    "op5_source_mixing": mixing.op5,
    "op6_near_duplicates": neardup.op6,
    "op7_url_rules": urlrules.op7,
    "op8_toxicity": toxicity.op8,
    "op9_license_scan": licenses.op9,
    "op10_quality_divergence": divergence.op10,
    "op11_nearest_vectors": ann.op11,
    "op12_vector_codes": veccodes.op12,
    "op13_ranked_search": ranked.op13,
}
ORACLES: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE,
    "op11_nearest_vectors": ann.ORACLE,
    "op12_vector_codes": veccodes.ORACLE,
    "op13_ranked_search": ranked.ORACLE,
}
