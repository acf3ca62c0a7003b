"""Incremental use of the resolver."""
