"""Whole jobs composed from the operators: feature step, scoring, training, search."""
