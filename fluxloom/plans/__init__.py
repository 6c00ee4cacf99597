"""Registered queries and their SQL twins."""

from . import files, fluxes, scenes
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "fluxes", "scenes"]
