"""Column functions and small distributed algorithms shared by the operators."""
