"""Readers and writers for tables, documents and the response log."""
