"""Queries of this subpackage, each over whole tables, and comparison SQL where SQL can express them."""

from __future__ import annotations

from quernstone.llm import decontamination, filter_audit, language_id, manifest, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity, warc
from quernstone.session import table

QUERIES = {
    "op1_quality_classifier": lambda s, d: quality_classifier.op1(table(s, d, "documents"), table(s, d, "labels")),
    "op2_substring_dedup": lambda s, d: substring_dedup.op2(table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.op3(table(s, d, "documents"), table(s, d, "labels")),
    "op4_near_dedup": lambda s, d: near_dedup.op4(table(s, d, "documents")),
    "op5_token_counts": lambda s, d: token_counts.op5(table(s, d, "documents")),
    "op6_packing": lambda s, d: packing.op6(table(s, d, "documents")),
    "op7_quality_rules": lambda s, d: quality_rules.op7(table(s, d, "documents"), table(s, d, "labels")),
    "op8_language_id": lambda s, d: language_id.op8(table(s, d, "documents")),
    "op9_warc": lambda s, d: warc.op9(table(s, d, "pages")),
    "op10_decontamination": lambda s, d: decontamination.op10(table(s, d, "documents"), table(s, d, "benchmark")),
    "op11_mixing": lambda s, d: mixing.op11(table(s, d, "documents")),
    "op12_manifest": lambda s, d: manifest.op12(table(s, d, "documents")),
    "op13_filter_audit": lambda s, d: filter_audit.op13(table(s, d, "documents"), table(s, d, "labels")),
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.OP2_SQL, "op4_near_dedup": near_dedup.OP4_SQL, "op9_warc": warc.OP9_SQL,
    "op11_mixing": mixing.OP11_SQL, "op12_manifest": manifest.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL,
}
