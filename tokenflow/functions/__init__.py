"""Column-level functions (scalar derivations and validation rules)."""
