"""Independent SQL for the registered queries, runnable by DuckDB on the given tables."""

from .finals import ORACLES

__all__ = ["ORACLES"]
