"""Column functions: names and enumerations, bit vectors, Boolean expressions."""
