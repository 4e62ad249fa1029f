"""Queries and oracles by area; every query reads the driver tables."""

from __future__ import annotations

from importlib import import_module

AREAS = ("quality", "enrichment", "rollups", "threat", "lifecycle", "ml", "docs", "odd_rows", "readers", "replays")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        found = getattr(import_module(f"registry.{area}"), attribute)
        clash = merged.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(found)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
