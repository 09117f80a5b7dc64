"""The SQL dialect, its catalog, and the registered queries."""
