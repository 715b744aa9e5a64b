"""Column helpers over windows of one symbol."""
