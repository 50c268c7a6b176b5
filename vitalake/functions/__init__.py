"""Column-level helpers built only from native expressions."""
