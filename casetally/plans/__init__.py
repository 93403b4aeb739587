"""Reports composed of operators, and their binding to the test tables."""
