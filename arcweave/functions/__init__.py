"""Column expressions: node ids, typed value parsing."""
