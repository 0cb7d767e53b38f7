"""Structured Streaming forms of the event log: an extension, the batch operators are the ones of the survey."""
