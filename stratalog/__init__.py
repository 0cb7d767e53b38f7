"""Snapshot-versioned evidence analytics on Spark."""
