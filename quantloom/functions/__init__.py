"""Column helpers: scalar expressions and window kernels."""
