"""Column builders and NumPy kernels for vectors."""
