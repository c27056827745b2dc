"""Where a slice goes: Parquet, SQL text, SQLite, JDBC."""
