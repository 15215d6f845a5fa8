"""Imports every module of queries."""

from tessella.plans import evaluation, flagship, images, mixture, pose, prep, sinks, streaming, text, trajectory, vectors  # noqa: F401
from tessella.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
