"""A Spark-native engine for a compact query language over delimited text and Parquet tables."""

from __future__ import annotations

from importlib import import_module

__all__ = ["Engine", "Options", "QueryError", "Result"]


def __getattr__(name: str):
    """The engine is imported on first use: workers that unpickle a function of some module need no more than that module."""
    if name in __all__:
        return getattr(import_module(".engine", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
