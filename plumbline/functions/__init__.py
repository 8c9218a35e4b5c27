"""Column expressions and driver-side value rules shared by the operators."""
