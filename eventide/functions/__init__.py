"""Column functions: text, numbers, time, identity."""
