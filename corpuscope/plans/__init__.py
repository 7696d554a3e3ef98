"""Queries: operators bound to tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
