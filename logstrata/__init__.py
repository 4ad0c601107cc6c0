"""logstrata: log-structured key-value data as Spark DataFrames.

A table of ordered mutations is the source of truth; every state, lookup,
sorted run, compaction and physical model is a declarative plan over it.
"""
