"""Readers, writers and tables in the shared folder."""
