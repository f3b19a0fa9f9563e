"""sources of querylens."""
