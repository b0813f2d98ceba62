"""Column-level building blocks: missing values, rounding, text and numbers."""
