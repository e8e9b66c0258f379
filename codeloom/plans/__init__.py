"""Registered queries.  ``load_all`` imports every module that registers some."""

from __future__ import annotations

from importlib import import_module

MODULES = ["expressions", "sources", "graphs", "quality", "generation", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"codeloom.plans.{name}")
