"""Registered plans, grouped by subject."""

from __future__ import annotations

import importlib

from cloakframe.plans.registry import CHECKS, PLANS

MODULES = ("detection", "governance", "portfolio", "operations", "conversations", "streams", "chains", "rules")

__all__ = ["CHECKS", "PLANS", "load_all"]


def load_all() -> dict:
    for module in MODULES:
        importlib.import_module(f"cloakframe.plans.{module}")
    return dict(PLANS)
