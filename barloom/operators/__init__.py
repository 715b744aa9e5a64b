"""Indicators, as-of join, labels, signals and walk-forward validation."""
