"""Registered queries over the study-shaped views."""

from __future__ import annotations

import importlib

MODULES = ["queries_post", "queries_prep", "queries_scan", "queries_io"]


def load() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
