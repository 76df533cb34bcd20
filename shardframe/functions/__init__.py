"""Routing and key generation as Column expressions."""
