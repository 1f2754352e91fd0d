"""Readers and writers for sequence tables, preference files and logs."""
