"""Named queries over the test tables with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("records", "tagging", "geodesy", "rasters", "vectors", "bookkeeping", "texts", "colouring", "extras", "polygons", "pipelines")


def _merged(what: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"stratafold.queries.{name}"), what)
        if clash := merged.keys() & part.keys():
            raise ValueError(f"queries defined twice: {sorted(clash)}")
        merged |= part
    return merged


def all_queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
