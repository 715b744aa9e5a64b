"""The five steps and the report tables."""
