"""Readers, writers and the checks that tables are held to."""
