"""Column functions: statistics over windows and arrays, and parsing."""
