"""Readers, writers and the adapters that read tables as fields and series."""
