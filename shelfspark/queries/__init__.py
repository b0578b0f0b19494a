"""Registered queries: every operator run over the driver's tables, with equal SQL where it exists."""

from shelfspark.queries import catalog, events, library, links, reader, search, text  # noqa: F401
from shelfspark.queries.base import ORACLES, QUERIES  # noqa: F401
