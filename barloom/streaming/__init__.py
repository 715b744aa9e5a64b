"""Bars of tick streams."""
