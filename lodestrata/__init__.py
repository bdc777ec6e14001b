"""lodestrata: a PySpark-native engine for versioned, TTL-aware key-value data.

Tables are append-only change logs; every read is a DataFrame expression over
them.  The subpackage ``llm`` (training-data operators) is optional: nothing
else in the package imports it.
"""

__version__ = "0.1.0"
