"""A sample table in the expected shape, derived from the given test tables."""
