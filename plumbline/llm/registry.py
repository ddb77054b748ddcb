"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: module: (query, its function)
MODULES = {"licenses": "op6_licenses", "repeats": "op7_repeats", "topk": "op1_topk", "langid": "op3_language", "toxicity": "op10_toxicity", "simhash": "op9_simhash", "mixing": "op2_mixing", "line_dedup": "op4_line_dedup", "exact_dedup": "op5_exact_dedup", "bpe": "op8_bpe", "lexical": "op11_ranked_lexical", "periodic": "op12_periodic_runs", "sharding": "op13_sharding"}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"plumbline.llm.{module}"), name) for module, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in MODULES.items():
        if sql := getattr(importlib.import_module(f"plumbline.llm.{module}"), "SQL", None):
            found[name] = sql
    return found
