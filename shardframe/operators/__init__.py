"""Reads, relations, writes and movement of sharded tables."""
