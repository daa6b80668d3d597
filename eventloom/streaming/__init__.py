"""Histograms of a growing folder of event files: an extension over batch analysis."""
