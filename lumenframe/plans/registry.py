"""Every query by name, and the DuckDB SQL that must give the same rows."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
