"""Scoring new observations as they arrive."""
