"""Operators composed into end-to-end runs, and the registered queries."""

from __future__ import annotations

from importlib import import_module

AREAS = ("usage", "metrics", "text", "limits", "ocr", "enrichment", "state", "search", "accuracy", "sources", "streams")


def collect(kind: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        merged.update(getattr(import_module(f"lettermill.plans.{area}"), kind))
    return merged
