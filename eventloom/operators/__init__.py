"""Operators on the collections of an event, on weights, and on histograms."""
