"""Column-level helpers: markers, typing, names, text."""
