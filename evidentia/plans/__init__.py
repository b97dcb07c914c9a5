"""Named queries over the driver's tables: for each a Spark function and, where SQL can say it, DuckDB SQL.

The SQL of a view that is derived from orders states what must be found from the orders' own columns; it parses nothing.
"""
