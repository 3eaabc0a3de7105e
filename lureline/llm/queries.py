"""Queries of the subpackage and their check SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["prefix_hash", "feistel", "bpe", "warc", "simhash", "weak_quality", "balance", "suffix", "lang", "line_rules",
           "resample", "filter_audit", "token_counts"]


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(import_module(f"lureline.llm.{module}"), name))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
