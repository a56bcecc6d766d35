"""Readers and writers: driver tables, the flux bridge view, Parquet dataset stores, JSON settings."""
