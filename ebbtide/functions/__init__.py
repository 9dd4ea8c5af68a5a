"""Column expressions: rounding, hashing, engineered features, business rules, reason texts."""
