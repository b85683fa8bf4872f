"""Imports every module that registers queries."""

from .operators import art, evaluation, graph, guard, ingest, memory, retrieval, router, segments, text, vectors  # noqa: F401
from .sources import durability  # noqa: F401
from .streaming import windows  # noqa: F401
