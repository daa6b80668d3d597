"""Specs: their model, the text forms that they are read from, and the checks that they must pass."""
