"""Queries by area; importing registers them."""

from . import authority, content, evidence, log, service
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "authority", "content", "evidence", "log", "service"]
