"""Relational operators: segmentation, alignment, value pairing, reconciliation."""
