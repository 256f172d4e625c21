"""Column-level building blocks (expressions and the few Arrow functions)."""
