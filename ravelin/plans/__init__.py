"""Queries bound to the test tables, one module per family of operators."""

from __future__ import annotations

import importlib
import pkgutil

SKIPPED = {"registry", "fragments"}


def load_all() -> None:
    """Import every module so that its queries register themselves."""
    for module in pkgutil.iter_modules(__path__):
        if module.name not in SKIPPED:
            importlib.import_module(f"{__name__}.{module.name}")
