"""Training-data pipeline operators.  Nothing else in the library imports this package.

Each module holds one operator with its own general interface; :mod:`queries` holds the
thin registered queries and their DuckDB texts.
"""
