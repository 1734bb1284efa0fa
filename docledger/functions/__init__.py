"""Column expressions and group helpers shared by the operators."""
