"""Registered queries: each pairs a Spark plan on the given tables with the SQL that checks it."""

from importlib import import_module

MODULES = ("cleaning", "joins", "stats", "bands", "geo", "features", "reduce", "models", "profile")


def load():
    """Import all query modules and return (queries, oracle SQL)."""
    from catalog import registry

    for m in MODULES:
        import_module(f"catalog.{m}")
    return registry.QUERIES, registry.ORACLES
