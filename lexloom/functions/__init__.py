"""Column functions: text cleaning, nested values and arrays."""
