"""Part of the literature-graph engine."""
