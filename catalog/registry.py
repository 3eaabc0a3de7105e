"""Collects the query modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["text_url", "page", "advice", "audit", "corpora", "measure", "prepare", "learn"]


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"catalog.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")


def flagship(spark, sf_dir):
    return queries()["flagship_risk_by_tier"](spark, sf_dir)
