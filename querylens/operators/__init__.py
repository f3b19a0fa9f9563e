"""operators of querylens."""
