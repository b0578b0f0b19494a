"""Operators on DataFrames of files, folders, entries, sections, texts and events."""
