"""Registered queries: each operator on the given tables, with its SQL twin."""

from glossweave.catalog import core, layout, memory, people, sources, streams
from glossweave.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "core", "layout", "memory", "people", "sources", "streams"]
