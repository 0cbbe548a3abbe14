"""Named queries over the given tables, each with independent SQL to check it."""

from __future__ import annotations

import importlib

FAMILIES = ("drift", "preparation", "monitoring", "records", "models", "streams", "dashboards")


def load_all():
    """(queries, checking SQL) of every family."""
    from driftline.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"driftline.plans.{family}")
    return registry.QUERIES, registry.ORACLES
