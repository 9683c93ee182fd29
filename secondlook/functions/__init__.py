"""Column expressions: predicates, scalar rules and missing-value semantics."""
