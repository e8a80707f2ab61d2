"""Column expressions and small scalar statistics."""
