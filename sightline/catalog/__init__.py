"""Named queries over the given tables, with the SQL stating each result."""

from importlib import import_module

from sightline.catalog.registry import ORACLES, QUERIES

for _part in ("feeds", "linking", "reconcile", "checks", "scoring", "devices", "streams"):
    import_module(f"sightline.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
