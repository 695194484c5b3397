"""Query plans: the registered queries and the feature-extraction plan."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "q_profile",
    "q_infotheo",
    "q_phases",
    "q_summary",
    "q_cluster",
    "q_pairs",
    "q_eval",
    "q_shape",
    "q_models",
    "q_sources",
    "q_runs",
)


def load_all():
    from .registry import REGISTRY
    for m in QUERY_MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
