"""streaming of querylens."""
