"""Sources: file listings, archives, feeds, events, logs, dictionaries."""
