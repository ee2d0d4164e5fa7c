"""Column expressions and the arithmetic of privacy budgets."""
