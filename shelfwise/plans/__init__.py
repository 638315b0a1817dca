"""The registered queries, by pipeline."""

from __future__ import annotations

from importlib import import_module

MODULES = ["catalog", "intent", "retrieval", "compose", "quality", "requests", "evaluation", "tenants", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
