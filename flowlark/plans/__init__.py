"""Named queries over the supplied tables, each with checking SQL where SQL can say it."""

from __future__ import annotations

import importlib

from flowlark.plans.registry import CHECKS, QUERIES

MODULES = ["q_correlate", "q_profile", "q_alerts", "q_timeseries", "q_evaluate", "q_flowmeter", "q_files_streams", "q_models"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"flowlark.plans.{name}")


def all_queries() -> dict:
    _load()
    return QUERIES


def all_checks() -> dict:
    _load()
    return CHECKS
