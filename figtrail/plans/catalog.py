"""Loads every query module once."""

from __future__ import annotations

import importlib
import pkgutil

import figtrail.plans as plans
from figtrail.plans.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"figtrail.plans.{m.name}")
    return QUERIES, ORACLES
