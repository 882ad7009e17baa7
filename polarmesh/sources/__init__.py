"""Readers of mesh text, NetCDF classic, KML, iceberg and state files."""
