"""Lines from files and columns, and the index on disk."""
