"""All registered queries of the corridor and event operators and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``, with the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    for part in ("corridor", "labels", "events", "tables", "pixels", "spatial", "search", "sources", "checks"):
        importlib.import_module(f"swathe.plans.{part}")


load()
