"""Training-data operators: de-duplication, filters, extraction, search, packing.

Nothing else in the library imports this subpackage. Each module holds one operator with
a general interface; ``queries`` holds the thin registered queries over the shared tables
and ``oracle`` the DuckDB SQL of those that SQL can express.
"""
