"""Readers, writers and stored collections."""
