"""Readers, writers and the mapping of raw tables onto business roles."""
