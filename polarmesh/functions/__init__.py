"""Column functions: geometry, calendar, statistics."""
