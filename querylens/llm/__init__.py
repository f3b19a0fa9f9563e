"""Operators for the data of language-model training. Nothing outside this folder imports it."""
