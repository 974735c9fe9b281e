"""Incremental runs over folders that keep growing."""
