"""Operators over units, matches and findings."""
