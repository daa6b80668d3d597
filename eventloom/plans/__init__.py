"""Specs compiled to DataFrame plans."""
