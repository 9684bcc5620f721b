"""Column functions: text, vectors, counter-based uniform numbers, movMF densities."""
