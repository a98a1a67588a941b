"""Inputs: fixed-width files driven by a layout table, ZIP archives, nested
listing JSON, and the partition catalog of stored Parquet."""
