"""Incremental validation of a growing response log."""
