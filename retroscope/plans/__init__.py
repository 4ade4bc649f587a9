"""Whole jobs: the post layers, scoring, model studies and the query catalogue."""
