"""The queries opN_<name> of this subpackage, at production parameters over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _module in ("op01_quality", "op02_token_files", "op03_sharding", "op04_classifier", "op05_lines", "op06_secrets", "op07_decontamination", "op08_pieces", "op09_jaccard", "op10_substring", "op11_audit", "op12_bytes", "op13_phrases"):
    importlib.import_module(f"larkspan.llm.queries.{_module}")
