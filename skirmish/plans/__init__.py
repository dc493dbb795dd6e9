"""The registered queries (``catalog``) and their DuckDB oracle SQL (``oracle_tables``)."""
