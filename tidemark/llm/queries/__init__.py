"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this folder; each has ``query(spark, sf_dir)`` and ``SQL`` (or None).
MODULES = {
    "op10_near_duplicates": "op10",
    "op1_license_scan": "op1",
    "op2_quote_links": "op2",
    "op3_repeated_passages": "op3",
    "op4_decontamination": "op4",
    "op5_quality_classifier": "op5",
    "op6_quality_rules": "op6",
    "op7_mix_sources": "op7",
    "op8_page_text": "op8",
    "op9_pii_pseudonyms": "op9",
}


def queries() -> dict:
    return {name: importlib.import_module(f".{m}", __name__).query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f".{m}", __name__).SQL for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
