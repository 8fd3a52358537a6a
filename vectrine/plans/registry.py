"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from vectrine import plans


def _parts() -> list:
    return [importlib.import_module(f"vectrine.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")]


def queries() -> dict:
    return {k: v for part in _parts() for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _parts() for k, v in part.SQL.items()}
