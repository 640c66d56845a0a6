"""Composite runs and the query registry."""

from __future__ import annotations


def all_queries():
    """Every registered query and its check SQL."""
    import importlib
    import pkgutil

    from . import registry

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
