"""Column functions and small building blocks shared by the operators."""
