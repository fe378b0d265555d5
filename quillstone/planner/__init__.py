"""Questions and SQL text to validated, read-only, policy-checked DataFrames."""
