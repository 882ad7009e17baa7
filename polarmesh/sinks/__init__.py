"""Writers of mesh, iceberg, state and yearly files."""
