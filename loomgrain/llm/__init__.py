"""Training-data pipeline operators, their registered queries and their SQL.

Nothing outside this subpackage imports it; ``queries`` collects the registered
queries and ``sql`` the statements that DuckDB can run on the same tables.
"""
