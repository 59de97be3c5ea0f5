"""Scans, sources and sinks and the derived customer table (J5)."""
