"""The same results in DuckDB's SQL, where SQL can express them on whole tables."""

ORACLE: dict[str, str] = {}
