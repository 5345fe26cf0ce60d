"""Readers, writers and staging of tables."""
