"""Every operator as a query over the test tables, with a SQL check where there is one."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries() -> tuple[dict, dict]:
    """All registered queries and checks by name."""
    from workload import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"workload.{module.name}")
    return registry.QUERIES, registry.ORACLES
