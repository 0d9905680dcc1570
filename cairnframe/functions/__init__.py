"""Column functions: the formula language and shared text expressions."""
