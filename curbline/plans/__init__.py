"""The registered queries and the tables they derive from the given data."""
