"""Plan-building helpers: staged tables, size-checked broadcasts."""
