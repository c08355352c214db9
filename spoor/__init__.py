"""Spark-native analytics over the activity of AI coding agents."""

from spoor.workspace import Filters, Workspace

__all__ = ["Filters", "Workspace"]
