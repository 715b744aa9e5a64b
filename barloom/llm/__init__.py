"""Operators for building training data from text; nothing else in barloom imports this subpackage."""
