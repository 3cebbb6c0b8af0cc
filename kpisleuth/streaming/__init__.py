"""Structured Streaming versions of the daily KPI and of feed silence."""
