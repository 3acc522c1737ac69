"""Column functions on pixels and on header maps."""
