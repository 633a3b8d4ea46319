"""Registered queries, grouped by subject."""

from importlib import import_module

from fellwalk.plans.registry import all_oracles, all_queries

GROUPS = ("geo", "trails", "sources", "density", "routing", "detect", "imagery", "search", "gazetteer", "nav", "packs",
          "models")


def load() -> None:
    for g in GROUPS:
        import_module(f"fellwalk.plans.{g}")


__all__ = ["all_oracles", "all_queries", "load"]
