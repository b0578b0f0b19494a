"""Sinks: entries, feed documents, folder pages, event log."""
