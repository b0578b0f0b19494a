"""Metadata and covers of book files, one job per format over a table of files."""
