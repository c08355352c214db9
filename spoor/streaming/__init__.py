"""Structured Streaming versions of ingestion and of the live counters. Batch
results are the truth; each stream says how late a row may come."""
