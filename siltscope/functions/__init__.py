"""Column-level functions: text, numbers, scores, paths."""
