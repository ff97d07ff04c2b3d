"""Event-anchored, point-in-time analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame, so pipelines are
composed with ``df.transform`` and planned as a whole by Catalyst.
"""
