"""Fixture views over the driver tables, and the registry of named queries with their SQL."""
