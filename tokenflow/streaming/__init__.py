"""Structured Streaming variants: incremental ingestion with dedup (X1),
continuous time series (X2), sliding request rate (X3)."""
