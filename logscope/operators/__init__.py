"""DataFrame operators: assembly, correlation, tables, time axis."""
