"""Corvane: a PySpark-native text-retrieval and corpus-analytics engine.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the
caller asks for rows, except where a docstring says that a table is written.
"""

__version__ = "0.1.0"
