"""Registered queries over the driver's tables."""

from . import chunks, context, details, graph, lifecycle, metadata, quality, retrieval, structure  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
