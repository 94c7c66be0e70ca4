"""Registered queries: each composes operators over the given tables and states its DuckDB equivalent."""

from __future__ import annotations

from importlib import import_module, util

AREAS = ("sources", "scalars", "calendars", "joins", "windows", "ranking", "statistics", "portfolio", "resampling", "features", "quota", "learning", "documents")


def load_all() -> None:
    for area in AREAS:
        if util.find_spec(f"tidemark.plans.{area}"):
            import_module(f"tidemark.plans.{area}")
