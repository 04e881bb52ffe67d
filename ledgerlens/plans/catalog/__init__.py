"""Registered queries, each next to the SQL that states the same result."""

from . import clean, customers, kpis, learned, live, mapping, products, storage, text, timeseries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
