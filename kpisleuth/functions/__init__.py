"""Column helpers, statistics and skew-safe order statistics."""
