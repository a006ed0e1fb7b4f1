"""Change-impact analytics on PySpark: typed graph tables, bounded closures and risk queries."""
