"""Queries over the driver's tables: ``QUERIES`` by name, and ``ORACLES`` with their SQL."""

from . import flows  # noqa: F401 - adds its own
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
