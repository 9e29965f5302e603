"""Detectors: pure functions from tables and a moment to a table of findings."""
