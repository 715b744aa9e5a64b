"""Ticks and bars in, step tables out."""
