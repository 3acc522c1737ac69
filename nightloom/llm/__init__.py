"""Operators for the text of large training sets. Nothing else in the library imports this.

Each module names its queries in QUERIES and, where SQL can express one, its SQL in ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language_model, license_scan, line_dedup, mixing, near_dedup, quality_model, quality_rules, toxicity

MODULES = (line_dedup, license_scan, decontaminate, html_extract, near_dedup, quality_rules, mixing, toxicity, quality_model, language_model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
