"""Column builders: text rules, lexicons, attribute patterns, skew helpers."""
