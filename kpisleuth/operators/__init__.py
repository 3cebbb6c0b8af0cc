"""User-level operators, grouped by stage of an investigation."""
