"""Whole dataflows: comparison, chains, evaluation, review."""
