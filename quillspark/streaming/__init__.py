"""Incremental ingestion and windows."""
