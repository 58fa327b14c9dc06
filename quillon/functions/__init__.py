"""Functions of SQL and their Column forms."""
