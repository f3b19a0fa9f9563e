"""plans of querylens."""
