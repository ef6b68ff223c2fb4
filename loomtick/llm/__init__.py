"""Training-data operators: deduplication, privacy, quality, archives and token output.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; ``registry`` holds the queries that the driver runs.
"""
