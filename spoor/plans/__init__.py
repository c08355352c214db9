"""Pipelines and table builders put together from the operators."""
