"""Scans: files and records brought into the landing tables."""
