"""Scans composed from the operators."""
