"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Each module's queries; all take (spark, sf_dir).
OPERATORS = {
    "op1_lines": ("line_dedup", "op1_lines"),
    "op2_licences": ("licences", "op2_licences"),
    "op3_suffix": ("suffix_dedup", "op3_suffix"),
    "op4_html": ("html_extract", "op4_html"),
    "op5_secrets": ("secrets", "op5_secrets"),
    "op6_mix": ("mixing", "op6_mix"),
    "op10_jaccard": ("jaccard_join", "op10_jaccard"),
    "op7_leaks": ("benchmark_leaks", "op7_leaks"),
    "op8_quality": ("quality", "op8_quality"),
    "op9_lm": ("class_model", "op9_lm"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"kinweave.llm.{module}"), function) for name, (module, function) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(module for module, _ in OPERATORS.values()):
        out |= getattr(importlib.import_module(f"kinweave.llm.{module}"), "ORACLE", {})
    return out
