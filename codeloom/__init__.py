"""Code-knowledge analytics on Spark: files, lines, symbols, call edges, commits and pages as DataFrames."""
