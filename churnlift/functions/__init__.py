"""Column-level helpers: null rules, scalar functions, grouped modes."""
