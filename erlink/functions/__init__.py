"""Column functions: text canonicalisation, its tables, and string-similarity kernels."""
