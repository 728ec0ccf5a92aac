"""Scans of streams of units."""
