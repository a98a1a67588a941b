"""Outputs: Parquet files and tables, with idempotent and replace-by-source writes."""
