"""Column expressions: statistics, scores and small helpers."""
