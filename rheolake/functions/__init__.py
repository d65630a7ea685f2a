"""Column functions: signal, axes, vectors, text."""
