"""Routed ingestion of streams."""
