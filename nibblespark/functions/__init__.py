"""Column builders: bit packing and NumPy-like arithmetic."""
