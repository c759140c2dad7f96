"""Column functions and per-row transforms."""
