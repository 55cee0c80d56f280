"""Lakehouse tables, a write-ahead log and a leased task queue as Spark jobs."""
