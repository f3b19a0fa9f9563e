"""functions of querylens."""
