"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from dossier.llm import decontaminate, embedding_dedup, hard_negatives, importance, language, licenses, line_dedup, ngram_join, packing, pii, quality, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_pii": pii.op4_pii,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_licenses": licenses.op7_licenses,
    "op8_language": language.op8_language,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_quality": quality.op10_quality,
    "op11_importance": importance.op11_importance,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_pii": pii.SQL,
    "op5_warc": warc.SQL,
    "op7_licenses": licenses.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
    "op11_importance": importance.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
