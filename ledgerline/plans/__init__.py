"""Registered queries and their SQL."""

from . import calibration, documents, records, streams, warehouse
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "calibration", "documents", "records", "streams", "warehouse"]
