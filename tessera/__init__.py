"""tessera: a Spark-native engine for tabular ML data work.

Every public operator takes and returns DataFrames.  Nothing relies on row
order; every random choice is a hash of (id, seed, salt), so results repeat
for a given seed whatever the partitioning.
"""

__version__ = "0.1.0"
