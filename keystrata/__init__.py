"""Keystrata: versioned, keyed tables on Spark. A table is a log of keyed changes, and every answer is a query over it."""
